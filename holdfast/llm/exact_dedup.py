"""Exact dedup of an incoming batch against an immutable snapshot, and within the batch.

A snapshot never changes, so each shard of its digests gets a static binary fuse filter, built
once. Incoming digests are screened by the filter of their shard; only positives meet the
snapshot's exact buckets, where the bytes decide. Duplicates inside the new batch are grouped
separately. All groups are formed by grouping on (digest, text), which Spark combines in each
map task first: a text with a third of all rows is one row per map task, and equal bytes, not
equal digests, make a group.

Defined results: a null text is empty; a null id loses against any other and stays only if all
ids of its text are null; of rows equal in id and text one stays; an empty snapshot or batch is
allowed; other columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import ascii_lower, stored, whole_text

# Digests in one shard's filter, about: bounds the memory of building and probing.
SHARD_KEYS = 50_000
FILTER_SCHEMA = "shard long, seed long, segment long, segments long, slots binary"

c = F.col


# Binary fuse filter (three segments, eight-bit fingerprints), whole arrays at a time.


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three segments that follow one another."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``seed, segment length, segment starts, slots`` of distinct 64-bit keys."""
    n = max(2, len(keys))
    segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(room / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 100):
        h = _mixed(keys, seed)
        slots = _slots(h, segment, segments)
        used = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            # Slots with one key each; their keys leave together.
            single = np.flatnonzero(used == 1)
            if not len(single):
                break
            gone, at = np.unique(owner[single], return_index=True)
            rounds.append((gone, single[at]))
            for row in slots[:, gone]:
                np.subtract.at(used, row, 1)
                np.bitwise_xor.at(owner, row, gone)
            left -= len(gone)
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for gone, slot in reversed(rounds):
            a, b, d = slots[:, gone]
            table[slot] = prints[gone] ^ table[a] ^ table[b] ^ table[d]
        return seed, segment, segments, table.tobytes()
    raise ValueError("keys are not distinct")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, slots: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 of the others."""
    table = np.frombuffer(slots, np.uint8)
    h = _mixed(keys, seed)
    a, b, d = _slots(h, segment, segments)
    return (table[a] ^ table[b] ^ table[d]) == _prints(h)


def _keys(digests: pd.Series) -> np.ndarray:
    """The last 64 bits of hex digests; the first ones choose the shard."""
    return np.array([int(x[-16:], 16) for x in digests], np.uint64)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    built = build_filter(np.unique(_keys(rows["digest"])))
    return pd.DataFrame([(rows["shard"].iloc[0], *built)], columns=["shard", "seed", "segment", "segments", "slots"])


def _probe_shard(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if filters.empty or incoming.empty:
        return pd.DataFrame({"digest": pd.Series([], dtype=str)})
    one = filters.iloc[0]
    hit = probe_filter(_keys(incoming["digest"]), int(one.seed), int(one.segment), int(one.segments), one.slots)
    return incoming.loc[hit, ["digest"]]


# The operator


def digest_rows(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, old, norm, digest``: normalised whole text and its SHA-256."""
    return docs.select(
        c(id_col).alias("doc_id"),
        F.coalesce(in_snapshot, F.lit(True)).alias("old"),
        ascii_lower(whole_text(text_col)).alias("norm"),
    ).withColumn("digest", F.sha2(c("norm"), 256))


def _shard(shards: int) -> Column:
    return F.conv(F.substring(c("digest"), 1, 8), 16, 10).cast("long") % F.lit(shards)


def shard_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of the digests in ``buckets``."""
    sharded = buckets.select("digest", _shard(shards).alias("shard"))
    return sharded.groupBy("shard").applyInPandas(_build_shard, FILTER_SCHEMA)


def screened(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Digests of ``incoming`` that its shard's filter does not rule out."""
    sharded = incoming.select("digest", _shard(shards).alias("shard"))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_probe_shard, "digest string")


def text_groups(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` of each distinct text over snapshot and batch."""
    exact = stored(
        rows.groupBy("old", "digest", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")),
        "exact-buckets",
    )
    snapshot, batch = exact.where("old").drop("old"), exact.where("NOT old").drop("old")
    sizes = exact.agg(F.count(F.when(c("old"), 1)), F.count(F.when(~c("old"), 1))).first()
    shards = max(1, math.ceil(max(sizes) / SHARD_KEYS))

    positives = screened(batch, shard_filters(snapshot, shards), shards)
    # The byte check: candidates meet the bucket of their digest, equal texts match.
    candidates = batch.join(positives, "digest", "left_semi").select("digest", "norm")
    known = stored(
        snapshot.join(candidates, ["digest", "norm"]).select(
            "digest", c("keep").alias("old_keep"), c("n").alias("old_n")
        ),
        "exact-known",
    )
    new = batch.select("digest", "keep", "n").join(known, "digest", "left")
    old = snapshot.select("digest", "keep", "n").join(known, "digest", "left_anti")
    return new.select(
        "digest",
        F.greatest("keep", "old_keep").alias("keep_id"),
        (c("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
    ).unionByName(old.select("digest", c("keep").alias("keep_id"), c("n").alias("group_size")))


def decisions(rows: DataFrame) -> DataFrame:
    """One row per row of ``digest_rows``: ``doc_id, digest, keep_id, group_size, kept``."""
    # Rows equal in id and text count once in the join and come back as many; one is kept.
    each = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("times"))
    joined = each.join(text_groups(rows), "digest")
    numbered = joined.withColumn("turn", F.explode(F.sequence(F.lit(1), c("times").cast("int"))))
    return numbered.select(
        "doc_id",
        "keep_id",
        "group_size",
        (c("doc_id").eqNullSafe(c("keep_id")) & (c("turn") == 1)).alias("kept"),
        "digest",
    )


def snapshot_before(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Ids below the middle of their range are the snapshot, the others the incoming batch."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(True) if low is None else c(id_col) < F.lit((low + high + 1) // 2)


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document."""
    cut = snapshot_before(docs) if in_snapshot is None else in_snapshot
    return decisions(digest_rows(docs, cut)).withColumnRenamed("digest", "text_sha256")


def without_copies(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    cut = snapshot_before(docs) if in_snapshot is None else in_snapshot
    stay = decisions(digest_rows(docs, cut)).where("kept").select(
        c("doc_id").alias("_stay_id"), c("digest").alias("_stay_digest")
    )
    own = F.struct(*[c(name) for name in docs.columns])
    keyed = docs.select(
        own.alias("_row"),
        c("doc_id").alias("_id"),
        F.sha2(ascii_lower(whole_text()), 256).alias("_digest"),
    )
    same = Window.partitionBy("_id", "_digest").orderBy(F.xxhash64("_row"))
    first = keyed.withColumn("_turn", F.row_number().over(same)).where("_turn = 1")
    kept = first.join(
        stay, c("_id").eqNullSafe(c("_stay_id")) & (c("_digest") == c("_stay_digest")), "left_semi"
    )
    return kept.select("_row.*")
