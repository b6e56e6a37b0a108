"""How filters interact, from decision diagrams of failure masks.

Each document has a mask of the filters it fails. Masks are counted per part by Spark; a part then
is at most 2**n counts for n filters, and parts are worked on side by side.

A diagram has a level per filter; a node leads on to the documents that pass and to those that
fail, equal nodes of a level are one, and each carries the counts (documents, and those of each
mark) of what lies below. Going down the all-pass path, the failing side of each node is what
that filter removes at that step. The next order of filters differs by one swap of neighbours (each
order of n-1 filters has the last one moved through all places, to and fro), and so needs one swap
of two adjacent levels, which changes no node elsewhere.

Exact copies: a document fails if its text stands under a smaller id anywhere in the table. Texts
are compared by their SHA-256. The smallest id is found in rows already counted per text and part,
so a text that a third of all documents share is a few rows for each task.

Defined results: a null text is empty, a null part the empty string. A null id is no smaller id and
has none before it, and no marks. Rows with equal ids and texts are not copies of each other.
Repeated marks of an id count once, if any of them is true. A filter that is null for a document
isn't failed. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import stored, whole_text

# Bounds of the five filters.
WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"

c = F.col
Counts = tuple[int, ...]


class Node:
    """Documents that pass (``low``) and fail (``high``) a level's filter; without them, counts."""

    __slots__ = ("low", "high", "weight")

    def __init__(self, low: "Node | None", high: "Node | None", weight: Counts):
        self.low, self.high, self.weight = low, high, weight


def _sum(a: Counts, b: Counts) -> Counts:
    return tuple(x + y for x, y in zip(a, b))


class Diagram:
    """Counts of masks as a decision diagram whose levels can be swapped."""

    def __init__(self, masks: dict[int, Counts], filters: int, width: int):
        self.order = list(range(filters))
        self.levels: list[dict[tuple[int, int], Node]] = [{} for _ in range(filters)]
        ends: dict[Counts, Node] = {}
        zero = (0,) * width

        def built(level: int, mask: int) -> Node:
            if level == filters:
                counts = masks.get(mask, zero)
                return ends.setdefault(counts, Node(None, None, counts))
            return self._node(level, built(level + 1, mask), built(level + 1, mask | 1 << level))

        self.root = built(0, 0)

    def _node(self, level: int, low: Node, high: Node) -> Node:
        found = self.levels[level].get((id(low), id(high)))
        if found is None:
            found = Node(low, high, _sum(low.weight, high.weight))
            self.levels[level][id(low), id(high)] = found
        return found

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes of the upper one stay the nodes they are, with
        other children; those of the lower one are made anew."""
        upper, self.levels[level + 1] = list(self.levels[level].values()), {}
        for node in upper:
            low, high = node.low, node.high
            node.low = self._node(level + 1, low.low, high.low)
            node.high = self._node(level + 1, low.high, high.high)
        self.levels[level] = {(id(n.low), id(n.high)): n for n in upper}
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[Counts, Counts]]:
        """``removed, kept`` of each step of the present order."""
        node, result = self.root, []
        while node.low is not None:
            result.append((node.high.weight, node.low.weight))
            node = node.low
        return result


def swaps(n: int) -> Iterator[int]:
    """Places of neighbour swaps that lead through all orders of ``n``: the last one goes through
    all places of each order of the others, to and fro."""
    if n < 2:
        return
    back = True
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        if inner is not None:
            # The others lie behind the moving one when it stands in front.
            yield inner + 1 if back else inner
        back = not back


def audited(masks: dict[int, Counts], filters: int, width: int) -> Iterator[tuple]:
    """``order, step, filter, removed, kept, fails, only, shapley`` of every order and step."""
    diagram = Diagram(masks, filters, width)
    walks = [(tuple(diagram.order), diagram.steps())]
    for place in swaps(filters):
        diagram.swap(place)
        walks.append((tuple(diagram.order), diagram.steps()))
    fails, only, shapley = {}, {}, dict.fromkeys(range(filters), 0)
    for order, steps in walks:
        fails[order[0]] = steps[0][0][0]
        only[order[-1]] = steps[-1][0][0]
        for f, (removed, _) in zip(order, steps):
            shapley[f] += removed[0]
    for order, steps in walks:
        for n, (f, (removed, kept)) in enumerate(zip(order, steps), 1):
            yield order, n, f, removed, kept, fails[f], only[f], shapley[f]


def interactions(masks: DataFrame, names: str, marks: list[str]) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails``, ``<mark>_lost`` for each
    mark, ``shapley`` from counts ``part, mask, docs`` and marks. Bit i of a mask is filter
    ``names[i]``."""
    if not 1 <= len(names) <= 8:
        raise ValueError("an audit of all orders takes one to eight filters")
    schema = pa.schema(
        [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
        + [(x, pa.int64()) for x in ("kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley")]
    )

    def of_part(key, table):
        counts = zip(*(table.column(x).to_pylist() for x in ("docs", *marks)))
        by_mask = dict(zip(table.column("mask").to_pylist(), counts))
        rows = [
            (key[0].as_py(), "".join(names[i] for i in order), step, kept[0], removed[0], fails - removed[0], only,
             *removed[1:], shapley)
            for order, step, _, removed, kept, fails, only, shapley in audited(by_mask, len(names), 1 + len(marks))
        ]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    kinds = {"string": "string", "int32": "int", "int64": "long"}
    return masks.groupBy("part").applyInArrow(of_part, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def failure_masks(
    docs: DataFrame, filters: dict[str, Column], marked: DataFrame, part: Column, *,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``part, mask, docs`` and a count of each mark of ``marked`` (``doc_id`` and booleans).

    ``filters`` are failure conditions on the columns of ``docs``, the first is bit 0; the bit after
    the last is that of exact copies.
    """
    marks = [x for x in marked.columns if x != "doc_id"]
    mask = F.lit(0)
    for n, failed in enumerate(filters.values()):
        mask = mask + F.when(failed, F.lit(1 << n)).otherwise(F.lit(0))
    narrow = stored(
        docs.select(
            c(id_col).alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
            F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)).alias("digest"),
        ),
        "audit-masks",
    )
    once = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(x), F.lit(False)).alias(x) for x in marks])
    with_marks = narrow.where("doc_id IS NOT NULL").join(once, "doc_id", "left")
    counts = ["docs", *marks]
    by_id = with_marks.groupBy("doc_id", "digest", "part", "mask").agg(
        F.count("*").alias("docs"), *[F.count_if(x).alias(x) for x in marks]
    )
    by_text = by_id.groupBy("digest", "part", "mask").agg(
        F.min_by(F.struct("doc_id", *counts), "doc_id").alias("least"), *[F.sum(x).alias(x) for x in counts]
    )
    # At most a row per part and mask for each text.
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    first = F.when(c("least.doc_id") == c("least_id"), c("least"))
    own = [F.coalesce(first[x], F.lit(0)) for x in counts]
    copy = 1 << len(filters)
    sides = F.array(
        F.struct(c("mask").alias("mask"), *[x.alias(n) for x, n in zip(own, counts)]),
        F.struct((c("mask") + copy).alias("mask"), *[(c(n) - x).alias(n) for x, n in zip(own, counts)]),
    )
    known = by_text.withColumn("least_id", least).select("part", F.inline(sides)).where("docs > 0")
    unknown = narrow.where("doc_id IS NULL").select(
        "part", "mask", F.lit(1).cast("long").alias("docs"), *[F.lit(0).cast("long").alias(x) for x in marks]
    )
    return known.unionByName(unknown).groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in counts])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters on whole texts, per source, in all 120 orders."""
    text = whole_text()
    texts = docs.select("doc_id", "text", "source", F.array_remove(F.split(text, SPACE), "").alias("words"))
    counted = texts.withColumns({"n": F.size("words"), "different": F.size(F.array_distinct("words"))})
    filters = {
        "A": c("n") < WORDS,
        "B": 100 * c("different") < DISTINCT_PERCENT * c("n"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }
    marked = labels.select("doc_id", (c("quality") == 1).alias("good"), (c("toxic") == 1).alias("toxic"))
    masks = failure_masks(counted, filters, marked, c("source"))
    return interactions(masks, "".join(filters) + "E", ["good", "toxic"])
