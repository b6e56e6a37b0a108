"""Integer vectors, and searches of query rows against all rows in blocks.

Rows are dealt to shards of bounded size and queries to blocks; a cell is one shard with one
block. A task keeps the shard of its cell in memory and streams the block's queries past it, so
memory does not grow with the input, and no key decides where a row goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.tables import stored

SCALE = 256
# Rows of a shard and queries of a block at most; queries that meet a shard at once.
MOST_ROWS, TILE = 65_536, 64
# Vector components that a shard may hold.
MOST_COMPONENTS = 1 << 22
LAST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min

c = F.col


@dataclass(frozen=True)
class Grid:
    """Numbers of shards and of query blocks."""

    shards: int
    blocks: int

    def tasks(self, df: DataFrame) -> int:
        spark = df.sparkSession
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return min(self.shards * self.blocks, max(usual, 2 * spark.sparkContext.defaultParallelism))


def grid(df: DataFrame, rows: int, queries: int, dims: int) -> Grid:
    """Shards of bounded size; more of them while there are cores without one."""
    most = max(64, min(MOST_ROWS, MOST_COMPONENTS // max(1, dims)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(rows / most), min(cores, rows // 1024))
    return Grid(shards, max(1, math.ceil(queries / most)))


def integer_vectors(df: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``df`` with ``vector``, the floor of each component times ``scale``, its length ``dims`` and
    its squared norm ``norm2``.

    Rows whose vector is null or holds null or non-finite components are left out. A component
    outside 32 bits is an error.
    """
    names = df.columns
    place = names.index(vector_col)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            bad = lists.is_null().to_numpy(zero_copy_only=False)
            bad[owner[~np.isfinite(flat)]] = True
            own = ~bad[owner]
            values = np.floor(flat[own] * scale)
            if len(values) and np.abs(values).max() >= 2**31:
                raise ValueError(f"a component times {scale} has more than 32 bits")
            sizes = lengths[~bad]
            norms = np.bincount(owner[own], values * values, minlength=len(lengths))[~bad]
            kept = batch.filter(pa.array(~bad))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
            others = [kept.column(i) for i in range(len(names)) if i != place]
            yield pa.RecordBatch.from_arrays(
                [*others, vectors, pa.array(sizes), pa.array(norms)],
                names=[*(n for n in names if n != vector_col), "vector", "dims", "norm2"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vector_col]
    return df.mapInArrow(floored, ", ".join([*fields, "vector array<int>", "dims long", "norm2 double"]))


def dealt(items: DataFrame, queries: DataFrame, tasks: int) -> DataFrame:
    """Items (``kind`` 0) and queries (1) with the same columns, each ``cell`` in one task."""
    both = items.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)))
    return both.repartition(tasks, "cell").sortWithinPartitions("cell", "kind")


def searched(batches: Iterator[pa.RecordBatch], shard_of: Callable[[pa.Table], Callable], tile: int = TILE) -> Iterator:
    """Results of each cell: ``shard_of`` makes a search from a cell's items, which then gets its
    queries in tiles."""
    current, parts, search = None, [], None
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(cell)]):
            if high == low:
                continue
            if cell[low] != current:
                current, parts, search = cell[low], [], None
            if kind[low] == 0:
                parts.append(batch.slice(low, high - low))
                continue
            if search is None:
                if not parts:
                    continue
                search, parts = shard_of(pa.Table.from_batches(parts)), []
            for at in range(low, high, tile):
                yield from search(batch.slice(at, min(tile, high - at)))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    result = np.zeros((len(lengths), dims), np.int64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    result[row, np.arange(lengths.sum()) - starts[row]] = lists.flatten().to_numpy(zero_copy_only=False)
    return result


def numbers(column: pa.Array, missing: int = LAST) -> np.ndarray:
    """Integers, null ones as ``missing``."""
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, column`` of the k highest scores of each row, of equal ones the leftmost; scores of
    ``NONE`` don't count."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = scores.shape[1]
    bound = np.partition(scores, width - k, axis=1)[:, width - k] if width > k else scores.min(axis=1)
    row, column = np.nonzero((scores >= bound[:, None]) & (scores != NONE))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def nulls_last(name: str) -> Column:
    return F.asc_nulls_last(name)


def prepared(df: DataFrame, id_col: str, vector_col: str, others: dict[str, Column], label: str) -> DataFrame:
    """``row, vec_id``, ``others``, ``vector, dims, norm2`` of all usable rows, stored once: ``row``
    tells rows with equal ids apart and must not change when a task runs again."""
    narrow = df.select(
        F.monotonically_increasing_id().alias("row"),
        c(id_col).cast("long").alias("vec_id"),
        *[column.alias(name) for name, column in others.items()],
        c(vector_col).alias("vector_"),
    )
    return stored(integer_vectors(narrow, "vector_"), label)
