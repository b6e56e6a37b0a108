"""SimHash near-duplicates through BK-trees.

A fingerprint bit is 1 if it is set in over half of a text's shingle hashes. Distinct
fingerprints are dealt to shards: with the 64 bits in ``BLOCKS`` blocks, two fingerprints that
differ in at most ``radius`` bits agree on all but ``radius`` of the blocks, so they meet in the
shard of those blocks' bits. Each shard holds a BK-tree, whose children are keyed by their
Hamming distance to the parent; a search follows only the edges within the radius. A tree is
built where its shard's fingerprints are dealt. It is not broadcast, as it grows with the data.

A shard over ``SHARD_MOST`` fingerprints builds no tree: its members are dealt once more by
``FINE_BLOCKS`` blocks, after which a shard has at most 2 ** 8 distinct members. So no tree is
unbounded and no link is lost. Shards give a star for each linked group, never all pairs;
components come from rounds of large-star and small-star over those links, each round written
to the shared folder.

Defined results: a null text is empty; texts without words have fingerprint 0 and link like any
other; shorter texts than a shingle are one shingle; texts are read whole; repeated rows give a
row each; a null id never becomes a component's id unless all ids of the component are null; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import stored, whole_text

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCKS, FINE_BLOCKS, SHARD_MOST = 5, 16, 2048
# Words whose shingles are hashed at a time.
STEP = 200_000

c = F.col


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    import xxhash

    # Lower-cases A-Z only, and splits at \\x20 and \\x09-\\x0D only.
    words = text.encode().lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, STEP):
        block = words[at : min(at + STEP, last) + shingle - 1]
        if len(block) < shingle:
            shingles = [b" ".join(block)]
        else:
            shingles = map(b" ".join, zip(*(block[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, print`` of each row; ``print`` is the fingerprint as a signed long."""
    narrow = docs.select(
        c(id_col).alias("doc_id"),
        F.xxhash64(whole_text(text_col)).alias("text_hash"),
        whole_text(text_col).alias("text"),
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_hash", "print"],
            )

    return narrow.mapInArrow(printed, f"doc_id {kind}, text_hash long, print long")


class BKTree:
    """Integers under Hamming distance; children are keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of nodes within the radius; only edges that can lead to one are followed."""
        found, open_ = [], [0] if self.nodes else []
        while open_:
            i = open_.pop()
            distance = (self.nodes[i] ^ value).bit_count()
            if distance <= radius:
                found.append(i)
            for edge, child in self.children[i].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(child)
        return found

    def add(self, value: int) -> int:
        """Adds a value that isn't in the tree yet; its index."""
        new, i = len(self.nodes), 0
        self.nodes.append(value)
        self.children.append({})
        while new:
            edge = (self.nodes[i] ^ value).bit_count()
            child = self.children[i].get(edge)
            if child is None:
                self.children[i][edge] = new
                break
            i = child
        return new


def shard_stars(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links (member, smallest member) of each group that is linked inside one shard."""
    tree, root = BKTree(), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for value in values:
        linked = tree.near(value, radius)
        mine = tree.add(value)
        root.append(mine)
        for i in linked:
            a, b = top(i), top(mine)
            root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, value in enumerate(values):
        least[top(i)] = min(value, least.get(top(i), value))
    for i, value in enumerate(values):
        if value != least[top(i)]:
            yield value, least[top(i)]


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bits of all blocks but ``radius``, as signed longs, for each choice."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(kept) for kept in combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(prints: DataFrame, blocks: int, radius: int, most: int | None) -> DataFrame:
    """``a, b``: links found in shards; of a shard over ``most``, its members with null ``b``."""
    masks = block_masks(blocks, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), c("print").bitwiseAND(F.lit(m)).alias("bits"))
                               for i, m in enumerate(masks)]))
    dealt = prints.select(keys.alias("key"), "print").select("key.mask", "key.bits", "print")
    sorted_ = dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "print")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, run, over = None, [], False
        found: list[tuple[int, int, bool]] = []

        def close() -> None:
            if over:
                found.extend((x, x, True) for x in run)
            elif len(run) > 1:
                found.extend((x, y, False) for x, y in shard_stars(run, radius))

        def rows() -> pa.RecordBatch:
            # Without a sign for bit counts, with one in the tables.
            a, b = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in (0, 1))
            none = np.array([x[2] for x in found], bool)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none)], names=["a", "b"])

        for batch in batches:
            mask, bits, values = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            for low, high in zip([0, *starts], [*starts, len(mask)]):
                key = (mask[low], bits[low])
                if key != run_key:
                    close()
                    run_key, run, over = key, [], False
                run += values[low:high].view(np.uint64).tolist()
                if most and len(run) > most:
                    over = True
                    close()
                    run = []
            if found:
                yield rows()
        close()
        yield rows()

    return sorted_.mapInArrow(linked, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b`` with a > b: links that join all distinct ``print`` within the radius."""
    coarse = stored(_stars(prints, BLOCKS, radius, SHARD_MOST), "simhash-links")
    crowded = coarse.where("b IS NULL").select(c("a").alias("print")).distinct()
    fine = _stars(crowded, FINE_BLOCKS, radius, None)
    return coarse.where("b IS NOT NULL").unionByName(fine).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` of every node in ``edges`` (``a, b``); root is the smallest node reachable.

    Large-star: neighbours above a node move to its smallest neighbour. Small-star: neighbours
    below do. Both keep the components and end in stars around the roots.
    """
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, last = stored(one_way.distinct(), label), None
    while True:
        seen = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == last or not seen[0]:
            return state.select(c("a").alias("node"), c("b").alias("root")).unionByName(
                state.select(c("b").alias("node"), c("b").alias("root")).distinct()
            )
        last = seen
        both = state.unionByName(state.select(c("b").alias("a"), c("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), c("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(c("b").alias("a"), c("low").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(below, "a")
        small = moved.where("b <> low").select(c("b").alias("a"), c("low").alias("b")).unionByName(
            below.select("a", c("low").alias("b"))
        )
        state = stored(small.distinct(), label)


def labelled(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``print, component_id, keep_id, keep_hash`` of each distinct fingerprint.

    ``keep_*`` name the row that stands for the component: smallest id, nulls last.
    """
    order = F.struct(c("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = stored(prints.groupBy("print").agg(F.min(order).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("print"), radius), "simhash-components")
    placed = distinct.join(roots, c("print") == c("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("keep"))
    return placed.join(least, "root").select(
        "print",
        c("keep.doc_id").alias("component_id"),
        c("keep.doc_id").alias("keep_id"),
        c("keep.text_hash").alias("keep_hash"),
    )


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    labels = labelled(prints, radius).select("print", "component_id")
    return prints.join(labels, "print").select("doc_id", hex16(c("print")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    stay = labelled(prints, radius).select("keep_id", "keep_hash").distinct()
    keyed = docs.select(
        F.struct(*[c(name) for name in docs.columns]).alias("_row"),
        c("doc_id").alias("_id"),
        F.xxhash64(whole_text()).alias("_hash"),
    )
    same = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row"))
    first = keyed.withColumn("_turn", F.row_number().over(same)).where("_turn = 1")
    kept = first.join(
        stay, c("_id").eqNullSafe(c("keep_id")) & (c("_hash") == c("keep_hash")), "left_semi"
    )
    return kept.select("_row.*")
