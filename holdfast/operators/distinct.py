"""Exact distinct counts that can be merged.

A distinct count can't be added up: the users of two days are not the sum of both days' users.
The set of them can. Here it is kept as bitmaps of integer keys, 32,768 keys to a bitmap, for the
finest groups asked for; every coarser count is the OR of stored bitmaps and needs no second scan
of the rows. A very active key costs one row per group and task before the first shuffle.

A bitmap has 4 kB however few keys are in it, so keys should be dense integers, and groups have
many keys; a group with few pays for the whole bitmap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.features import flag

c = F.col

_BUCKET = "__bucket"


def key_bitmaps(
    rows: DataFrame, key: str, by: Sequence[str], sets: Mapping[str, Column]
) -> DataFrame:
    """Bitmaps of the keys for which each condition of ``sets`` holds in some row of a group.

    Rows without a key are in no set. A group may have NULL as its name.
    """
    once = (
        rows.filter(c(key).isNotNull())
        .groupBy(*by, key)
        .agg(*[F.max(flag(condition)).alias(name) for name, condition in sets.items()])
    )
    position = F.bitmap_bit_position(c(key))
    return once.groupBy(*by, F.bitmap_bucket_number(c(key)).alias(_BUCKET)).agg(
        *[F.bitmap_construct_agg(F.when(c(name) == 1, position)).alias(name) for name in sets]
    )


def counted(bitmaps: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Distinct keys per group of ``by``, some of the columns the bitmaps were made for."""
    merged = bitmaps.groupBy(*by, _BUCKET).agg(*[F.bitmap_or_agg(c(name)).alias(name) for name in names])
    return merged.groupBy(*by).agg(*[F.sum(F.bitmap_count(c(name))).alias(name) for name in names])


def rolled_up(
    bitmaps: DataFrame, levels: Mapping[str, Sequence[str]], names: Sequence[str]
) -> DataFrame:
    """Distinct keys at several levels, from one pass over the bitmaps.

    ``levels`` names the columns of each level; the other columns are NULL in its rows.
    """
    columns = list(dict.fromkeys(name for level in levels.values() for name in level))
    sets = [[*map(c, level), c(_BUCKET)] for level in levels.values()]
    merged = bitmaps.groupingSets(sets, *map(c, columns), c(_BUCKET)).agg(
        F.grouping_id().alias("gid"), *[F.bitmap_or_agg(c(name)).alias(name) for name in names]
    )
    # One bit per grouping column, set where the level leaves it out; the bucket's is last and 0.
    level = F.lit(None).cast("string")
    for label, kept in levels.items():
        gid = sum(2 ** (len(columns) - i) for i, name in enumerate(columns) if name not in kept)
        level = F.when(c("gid") == gid, label).otherwise(level)
    return (
        merged.withColumn("level", level)
        .groupBy("level", *columns)
        .agg(*[F.sum(F.bitmap_count(c(name))).alias(name) for name in names])
    )


def trailing(bitmaps: DataFrame, day: str, days: int, names: Sequence[str], until: Column) -> DataFrame:
    """Distinct keys of the ``days`` days up to each day, from daily bitmaps.

    Each daily bitmap counts for ``days`` days; the rows behind it are not read again.
    """
    reach = F.sequence(c(day), F.least(F.date_add(c(day), days - 1), until))
    spread = bitmaps.filter(c(day) <= until).select(F.explode(reach).alias(day), _BUCKET, *names)
    return counted(spread, [day], names)
