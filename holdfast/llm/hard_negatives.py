"""Hard negatives by exact integer scores from float32 matrix products of residues.

Vectors become integers (the floor of 256 times each component). Their inner products are
computed in a residue number system: matrices modulo several primes below 1024, residues centred
around zero, are multiplied in float32. 64 products of such residues stay below 2**24, where
float32 is exact, so columns are taken 64 at a time. The Chinese remainder theorem, in balanced
mixed radix, gives the exact signed score; as many primes are used as twice the largest squared
norm needs, since no score exceeds that norm.

1. All rows are dealt to shards. Each anchor meets each shard and keeps the best rows of its own
   label; a window over these few finds its positives.
2. Each anchor meets each shard again, with its positives' scores: for each positive the highest
   scores of other labels between ``least`` and 100 percent of the positive's go on, and a
   window ranks them.

Only scores of an anchor with the best few rows of each shard are shuffled. Anchors are the stated
query set; all rows are candidates.

Defined results: rows with a null label, a null vector or null or non-finite components take no
part. Vectors of different lengths: the shorter one is filled up with zeros (an empty vector
scores 0). Rows with equal ids are rows of their own, "other" than each other; a null id is never
an anchor and comes last among ties. An anchor without positives, or a positive without
negatives, gives no row; an empty table gives none. A squared norm of 2**55 or more is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import stored
from holdfast.llm.vectors import NONE, Grid, best, dealt, grid, matrix, numbers, nulls_last, prepared, searched

ANCHORS, NOISE, CLASSES = 100, 7, 10
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
# Products of two centred residues that float32 adds exactly.
STEP = 64

c = F.col


def primes_below(limit: int) -> list[int]:
    """Primes under ``limit``, the largest first."""
    sieve = np.ones(limit, bool)
    sieve[:2] = False
    for n in range(2, int(limit**0.5) + 1):
        sieve[n * n :: n] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(bound: int) -> list[int]:
    """The fewest large primes whose product tells all numbers from ``-bound`` to ``bound`` apart."""
    chosen, product = [], 1
    for p in primes_below(1024):
        if product > 2 * bound + 1:
            break
        chosen.append(p)
        product *= p
    return chosen


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue nearest to zero."""
    r = x % p
    return np.where(r > p // 2, r - p, r)


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(vectors, p).astype(np.float32) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows behind the residues."""
    digits: list[np.ndarray] = []
    for left, right, p in zip(a, b, primes):
        total = np.zeros((left.shape[0], right.shape[0]), np.int64)
        for low in range(0, left.shape[1], STEP):
            total += (left[:, low : low + STEP] @ right[:, low : low + STEP].T).astype(np.int64)
        # What the digits so far stand for, modulo this prime.
        known, weight = 0, 1
        for digit, q in zip(digits, primes):
            known = known + digit * (weight % p)
            weight *= q
        digits.append(centred((total - known) % p * pow(weight, -1, p), p) if digits else centred(total, p))
    result = digits[-1]
    for digit, p in zip(digits[-2::-1], primes[-2::-1]):
        result = result * p + digit
    return result


class Shard:
    """The rows of a shard in order of id, with their residues."""

    def __init__(self, table: pa.Table, dims: int, primes: list[int]):
        table = table.combine_chunks()
        ids, rows = numbers(table["vec_id"]), numbers(table["row"])
        table = table.take(pa.array(np.lexsort((rows, ids))))
        self.ids, self.row = table["vec_id"].combine_chunks(), numbers(table["row"])
        self.label, self.primes = numbers(table["label"]), primes
        self.vectors = residues(matrix(table["vector"], dims), primes)

    def scores(self, batch: pa.RecordBatch, dims: int, rows=None, columns=None) -> np.ndarray:
        mine = residues(matrix(batch.column("vector"), dims), self.primes)
        mine = mine if rows is None else [x[rows] for x in mine]
        others = self.vectors if columns is None else [x[columns] for x in self.vectors]
        return products(mine, others, self.primes)


def nearest_of_label(table: pa.Table, dims: int, primes: list[int], k: int) -> Callable:
    """Search for the best rows of each anchor's own label."""
    shard = Shard(table, dims, primes)

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label, own = numbers(batch.column("label")), numbers(batch.column("row"))
        for value in np.unique(label):
            rows, columns = np.flatnonzero(label == value), np.flatnonzero(shard.label == value)
            scores = shard.scores(batch, dims, rows, columns)
            scores[own[rows][:, None] == shard.row[columns]] = NONE
            row, column = best(scores, k)
            row_at, column_at = pa.array(rows[row]), pa.array(columns[column])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(row_at), shard.ids.take(column_at), pa.array(shard.row[columns[column]]),
                 pa.array(scores[row, column])],
                names=["anchor_row", "vec_id", "other_row", "score"],
            )

    return search


def negatives_in_window(table: pa.Table, dims: int, primes: list[int], k: int, least: int) -> Callable:
    """Search, for each positive of an anchor, for the best rows of other labels in its window."""
    shard = Shard(table, dims, primes)

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = shard.scores(batch, dims)
        scores[numbers(batch.column("label"))[:, None] == shard.label] = NONE
        bounds = batch.column("bounds").to_pylist()
        for n in range(max(map(len, bounds))):
            rows = np.array([i for i, x in enumerate(bounds) if n < len(x)])
            top = np.array([bounds[i][n] for i in rows])[:, None]
            mine = scores[rows]
            inside = (mine <= top) & (mine != NONE)
            # 100 times the value that marks "none" is no number of 64 bits.
            inside &= np.where(inside, mine, 0) * 100 >= top * least
            mine = np.where(inside, mine, NONE)
            row, column = best(mine, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(rows[row])), pa.array(np.full(len(row), n, np.int32)),
                 shard.ids.take(pa.array(column)), pa.array(shard.row[column]), pa.array(mine[row, column])],
                names=["anchor_row", "place", "vec_id", "other_row", "score"],
            )

    return search


def _cells(rows: DataFrame, anchors: DataFrame, cells: Grid) -> DataFrame:
    """Every row in its shard, once for each block of anchors; every anchor in each shard."""
    shard = F.pmod(F.xxhash64("row"), F.lit(cells.shards))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(cells.blocks))
    columns = ["row", "vec_id", "label", "vector", "bounds"]
    items = rows.withColumn("bounds", F.lit(None).cast("array<long>")).select(
        *columns, shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(cells.blocks - 1))).alias("block")
    )
    asked = anchors.select(
        *columns, F.explode(F.sequence(F.lit(0), F.lit(cells.shards - 1))).alias("shard"), block.alias("block")
    )
    cell = (c("block") * cells.shards + c("shard")).cast("long").alias("cell")
    items, asked = (x.select(*columns, cell) for x in (items, asked))
    return dealt(items, asked, cells.tasks(rows))


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), nulls_last("vec_id"), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` tells which rows of ``vectors`` are anchors and ``label`` is the label they count
    with. A negative scores ``least`` to 100 percent of its positive.
    """
    extra = {"label": label.cast("long"), "is_anchor": F.coalesce(anchor, F.lit(False))}
    rows = prepared(vectors.where(label.isNotNull()), id_col, vector_col, extra, "negatives-rows")
    size = rows.agg(
        F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors"),
        F.coalesce(F.max("dims"), F.lit(0)).alias("dims"), F.coalesce(F.max("norm2"), F.lit(0.0)).alias("norm2"),
    ).first()
    if size.norm2 >= 2.0**55:
        raise ValueError("a hundred times a score must fit 64 bits")
    # Norms above 2**53 are rounded; one part in 2**40 more covers that.
    dims, primes = max(1, size.dims), moduli(int(size.norm2) + int(size.norm2) // 2**40 + 1)
    cells = grid(rows, size.rows, size.anchors, dims)
    anchors = rows.where("is_anchor")

    near = _cells(rows, anchors.withColumn("bounds", F.array().cast("array<long>")), cells).mapInArrow(
        lambda batches: searched(batches, lambda t: nearest_of_label(t, dims, primes, positives)),
        "anchor_row long, vec_id long, other_row long, score long",
    )
    best_positives = _ranked(near, positives, "anchor_row").groupBy("anchor_row").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")
    )
    known = anchors.join(best_positives, anchors["row"] == best_positives["anchor_row"])
    # Stored: the second pass and the names read it.
    asked = stored(known.select("row", "vec_id", "label", "vector", "positives"), "negatives-anchors")

    found = _cells(rows, asked.withColumn("bounds", c("positives.score")), cells).mapInArrow(
        lambda batches: searched(batches, lambda t: negatives_in_window(t, dims, primes, negatives, least)),
        "anchor_row long, place int, vec_id long, other_row long, score long",
    )
    ranked = _ranked(found, negatives, "anchor_row", "place").drop("other_row")
    named = asked.select(c("row").alias("anchor_row"), c("vec_id").alias("anchor_id"), "positives")
    chosen = F.get(c("positives"), c("place"))
    return ranked.join(named, "anchor_row").select(
        "anchor_id", chosen["vec_id"].alias("positive_id"), "rank", c("vec_id").alias("negative_id"),
        chosen["score"].alias("positive_score"), c("score").alias("negative_score"),
    )


def mined(embeddings: DataFrame) -> DataFrame:
    """Every hundredth id is an anchor; the labels of every seventh id are moved on by one."""
    label = F.when(c("vec_id") % NOISE == 0, (c("label") + 1) % CLASSES).otherwise(c("label"))
    return hard_negatives(embeddings, c("vec_id") % ANCHORS == 0, label)
