"""Exact top-k inner products over vectors in order of their length.

Vectors become integers (the floor of 256 times each component). All rows are rotated onto the
right singular vectors of their matrix (eigenvectors of the sum of outer products, one small
matrix), so that the first coordinates carry most of each score. By the Cauchy-Schwarz inequality
a score is at most a partial sum over the first coordinates plus the product of the lengths of
what is left. Bounds are taken in float64 with a margin far above their rounding error; a pair
is dropped only if its bound is below the query's k-th best score, and all others get their
exact integer score, so the result is exact.

1. Rows are dealt to shards by descending length: the first shard has the longest vectors.
2. All queries search the first shard, in blocks; their k-th scores are their thresholds.
3. A query goes on to the shards whose longest vector can still reach its threshold. Within a
   shard rows come in chunks of descending length, partial sums in stages; the threshold rises,
   and a chunk that is too short ends the search.
4. A window over the best few rows of each shard gives the result.

Defined results: vectors that are null or hold null or non-finite components take no part. Vectors
of different lengths: the shorter one is filled up with zeros (an empty vector scores 0). Rows
with equal ids are rows of their own and candidates of each other; a null id is no query and comes
last among ties. Fewer than k others: all of them. An empty table gives no rows. A squared norm
of 2**62 or more is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import stored
from holdfast.llm.vectors import Grid, dealt, grid, matrix, numbers, nulls_last, prepared, searched

QUERIES, HITS = 50, 5
# Parts of the coordinates after which bounds are checked; rows of the first chunk and at most.
STAGES, FIRST, CHUNK = (0.25, 0.5, 0.75), 256, 8_192
# Coordinates that are rotated; further ones stay as they are.
ROTATED = 512
# Part of the product of two lengths that covers the rounding of a bound.
MARGIN = 1e-9
# Lengths of shards that a query compares its threshold with.
RUNGS = 1_024

c = F.col


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the rows' first coordinates, the largest first, as columns.

    The driver gets one matrix of at most ``ROTATED`` rows and columns.
    """
    size = min(dims, ROTATED)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = matrix(batch.column("vector"), dims)[:, :size].astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({
            "i": np.repeat(np.arange(size), size), "j": np.tile(np.arange(size), size), "value": total.ravel(),
        })

    sums = rows.select("vector").mapInArrow(outer, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    gram = np.zeros((size, size))
    for i, j, value in sums.collect():
        gram[i, j] = value
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, ::-1]


class Rotated:
    """Vectors, rotated, with the lengths of what is left after each stage."""

    def __init__(self, lists: pa.Array, dims: int, turn: np.ndarray):
        self.exact = matrix(lists, dims)
        self.turned = self.exact.astype(float)
        size = len(turn)
        self.turned[:, :size] = self.turned[:, :size] @ turn
        self.cuts = sorted({max(1, int(dims * part)) for part in STAGES})
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.length = np.sqrt(squares[:, 0])
        rest = [squares[:, cut] if cut < dims else np.zeros(len(squares)) for cut in self.cuts]
        self.rest = np.sqrt(np.stack(rest, axis=1))


def survivors(q: Rotated, asked: np.ndarray, p: Rotated, low: int, high: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``query, row`` of all pairs of ``asked`` with the rows ``low`` to ``high`` whose bound
    reaches the threshold."""
    chunk = np.arange(low, high)
    room = MARGIN * q.length[asked][:, None] * p.length[low:high]
    sums, start = np.zeros((len(asked), high - low)), 0
    alive = np.ones(sums.shape, bool)
    for stage, cut in enumerate(q.cuts):
        sums += q.turned[asked, start:cut] @ p.turned[chunk, start:cut].T
        start = cut
        bound = sums + q.rest[asked, stage][:, None] * p.rest[chunk, stage] + room
        alive &= bound >= least[asked][:, None]
        wanted = alive.any(axis=0)
        # Rows that no query can use any more are left out of the next stage.
        chunk, sums, alive, room = chunk[wanted], sums[:, wanted], alive[:, wanted], room[:, wanted]
        if not len(chunk):
            break
    which, at = np.nonzero(alive)
    return asked[which], chunk[at]


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query = self.row = self.score = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        """``tie`` ranks all rows for equal scores."""
        if not len(query):
            return
        query, row, score = (np.concatenate(x) for x in ((self.query, query), (self.row, row), (self.score, score)))
        order = np.lexsort((tie[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        stay = place < self.k
        self.query, self.row, self.score = query[stay], row[stay], score[stay]
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


def longest_first(table: pa.Table, dims: int, turn: np.ndarray, k: int) -> Callable:
    """Search of a shard for each query's best rows."""
    table = table.combine_chunks()
    table = table.take(pa.array(np.lexsort((numbers(table["row"]), -table["norm2"].to_numpy()))))
    p = Rotated(table["vector"], dims, turn)
    ids, rows = table["vec_id"].combine_chunks(), numbers(table["row"])
    tie = np.empty(len(rows), np.int64)
    tie[np.lexsort((rows, numbers(ids)))] = np.arange(len(rows))

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, own = Rotated(batch.column("vector"), dims, turn), numbers(batch.column("row"))
        least = batch.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(float)
        found = Best(len(own), k, least)
        low, size = 0, FIRST
        while low < len(rows):
            high = min(low + size, len(rows))
            asked = np.flatnonzero(q.length * p.length[low] * (1 + MARGIN) >= found.least)
            if not len(asked):
                break
            query, row = survivors(q, asked, p, low, high, found.least)
            other = own[query] != rows[row]
            query, row = query[other], row[other]
            score = np.concatenate([
                np.einsum("ij,ij->i", q.exact[query[a : a + 16_384]], p.exact[row[a : a + 16_384]])
                for a in range(0, len(query), 16_384)
            ]) if len(query) else np.zeros(0, np.int64)
            found.add(query, row, score, tie)
            low, size = high, min(2 * size, CHUNK)
        at = pa.array(found.row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(found.query)), batch.column("vec_id").take(pa.array(found.query)),
             ids.take(at), pa.array(rows[found.row]), pa.array(found.score)],
            names=["query_row", "query_id", "vec_id", "other_row", "score"],
        )

    return search


FOUND = "query_row long, query_id long, vec_id long, other_row long, score long"
COLUMNS = ["row", "vec_id", "vector", "norm2", "least"]


def _dealt(items: DataFrame, queries: DataFrame, cells: Grid) -> DataFrame:
    """Shards once for each block of queries, queries (with a ``shard``) in their block."""
    items = items.withColumn("least", F.lit(None).cast("double"))
    items = items.select(*COLUMNS, "shard", F.explode(F.sequence(F.lit(0), F.lit(cells.blocks - 1))).alias("block"))
    queries = queries.select(*COLUMNS, "shard", F.pmod(F.xxhash64("row"), F.lit(cells.blocks)).alias("block"))
    cell = (c("block") * cells.shards + c("shard")).cast("long").alias("cell")
    return dealt(*(x.select(*COLUMNS, cell) for x in (items, queries)), cells.tasks(items))


def top_inner_products(
    vectors: DataFrame, query: Column, k: int = HITS, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each row that ``query``
    names with all other rows, ties to the smaller id."""
    rows = prepared(vectors, id_col, vector_col, {"is_query": F.coalesce(query, F.lit(False))}, "search-rows")
    size = rows.agg(
        F.count("*").alias("rows"), F.count_if("is_query").alias("queries"),
        F.coalesce(F.max("dims"), F.lit(0)).alias("dims"), F.coalesce(F.max("norm2"), F.lit(0.0)).alias("norm2"),
    ).first()
    if size.norm2 >= 2.0**62:
        raise ValueError("a score must fit 64 bits")
    dims = max(1, size.dims)
    turn = rows.sparkSession.sparkContext.broadcast(rotation(rows, dims))
    cells = grid(rows, size.rows, size.queries, dims)
    # The hash parts rows of equal length, the row number those that are equal in all else.
    by_length = rows.repartitionByRange(cells.shards, F.desc("norm2"), F.xxhash64("row"))
    shards = stored(by_length.withColumn("shard", F.spark_partition_id()), "search-shards")
    queries = shards.where("is_query").drop("shard")

    def search(items: DataFrame, asked: DataFrame, cells: Grid) -> DataFrame:
        return _dealt(items, asked, cells).mapInArrow(
            lambda batches: searched(batches, lambda t: longest_first(t, dims, turn.value, k)), FOUND
        )

    # The first shard meets all queries; they are dealt to more tasks, as it is one shard only.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    first = Grid(1, max(cells.blocks, min(cores, size.queries // 64)))
    asked = queries.withColumns({"least": F.lit(None).cast("double"), "shard": F.lit(0)})
    longest = stored(search(shards.where("shard = 0"), asked, first), "search-longest")

    # Longest vector of each shard; of many shards every n-th one, which bounds those after it.
    # Range partitions can be more or fewer than asked for.
    number = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    step = -(-number // RUNGS)
    rungs = shards.where(c("shard") % step == 0).groupBy((c("shard") / step).cast("int").alias("rung")).agg(F.max("norm2").alias("norm2"))
    ladder = {r.rung: r.norm2**0.5 * (1 + MARGIN) for r in rungs.collect()}
    # An empty shard has no length of its own; what follows it is no longer than what came before.
    lengths = [ladder.get(0, float("inf"))]
    for n in range(1, -(-number // step)):
        lengths.append(ladder.get(n, lengths[-1]))
    least = longest.groupBy("query_row").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least")
    )
    known = queries.join(least, c("row") == c("query_row"), "left")
    reached = F.size(F.filter(F.lit(lengths), lambda x: c("least").isNull() | (x * F.sqrt("norm2") * (1 + MARGIN) >= c("least"))))
    until = F.least(F.lit(number), reached * step)
    further = known.withColumn("until", until).where("until > 1").withColumn(
        "shard", F.explode(F.sequence(F.lit(1), c("until") - 1))
    )
    others = search(shards.where("shard > 0"), further, Grid(number, cells.blocks))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), nulls_last("vec_id"), "other_row")
    return (
        longest.unionByName(others).withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_report(embeddings: DataFrame) -> DataFrame:
    """Every fiftieth id is a query."""
    return top_inner_products(embeddings, c("vec_id") % QUERIES == 0)
