"""Exact running totals, quantiles and ranks over unbounded ordered data.

A window ordered over a whole table, or over one class of it, sorts everything in one task.
The operators here cut the order into buckets of about equal size, work inside the buckets in
parallel, and add what the earlier buckets hold. Results are exact: buckets decide only where
a row is processed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

c = F.col

# The most edges a plan carries; more partitions than this share buckets' work by size only.
_MOST_BUCKETS = 16_384

_BUCKET = "__bucket"
_HASH = "__hash"
_EDGES = "__edges"


def _wanted_buckets(spark: SparkSession) -> int:
    """Two buckets per shuffle partition, so that each task gets some."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _literal(numbers: Sequence[float]) -> Column:
    """An array of numbers as one literal: folded from text, so the plan names it once."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _hash_digits(spark: SparkSession) -> int:
    """Leading hex digits that give the wanted number of buckets: three (4096) or more."""
    return max(3, math.ceil(math.log(_wanted_buckets(spark), 16)))


def _with_value_bucket(distinct: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """Number the value range in order, with about as many distinct rows under each number.

    The edges are approximate quantiles of the distinct values: a few thousand numbers, a scalar
    subquery of the same plan, so nothing runs while the plan is built. A row finds its bucket in
    two steps, among the first edges of all stretches and then inside one.

    Values whose sums are all NULL are left out. That filter makes every branch of the query,
    the subquery too, read all the sums, so that all share one aggregation, and the source is
    scanned and shuffled once.
    """
    distinct = distinct.filter(F.coalesce(*names).isNotNull())
    buckets = min(_MOST_BUCKETS, max(16, _wanted_buckets(distinct.sparkSession)))
    position = c(value).cast("double")
    shares = _literal([i / buckets for i in range(1, buckets)])
    stride = math.ceil(math.sqrt(buckets))
    found = distinct.agg(F.percentile_approx(position, shares, F.lit(4 * buckets)).alias("found"))
    edges = F.array_sort(F.array_distinct(F.coalesce("found", F.array().cast("array<double>"))))
    last = F.floor((F.size("edges") - 1) / F.lit(stride)).cast("int")
    starts = F.when(F.size("edges") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    stretches = F.transform("starts", lambda i: F.slice("edges", i * stride + 1, F.lit(stride)))
    firsts = F.transform("starts", lambda i: F.get(c("edges"), i * stride))
    table = (
        found.select(edges.alias("edges"))
        .withColumn("starts", starts)
        .select(F.struct(firsts.alias("firsts"), stretches.alias("stretches")).alias("table"))
    ).scalar()
    firsts, stretches = (c(_EDGES)[name] for name in ("firsts", "stretches"))
    reached = F.size(F.filter(firsts, lambda edge: edge <= position))
    inside = F.size(F.filter(F.get(stretches, reached - 1), lambda edge: edge <= position))
    place = F.when(reached == 0, F.lit(0)).otherwise((reached - 1) * stride + inside)
    # Never NULL, and known to be: else the join would filter one branch and part it from the other.
    placed = distinct.withColumn(_EDGES, table).withColumn(_BUCKET, F.coalesce(place, F.lit(0)))
    return placed.drop(_EDGES)


def per_value(
    df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """The sums of each distinct ``value`` within ``by``; rows without value or group are left out.

    Equal values merge map side, so a value shared by a third of all rows is one row.
    """
    known = c(value).isNotNull()
    for name in by:
        known = known & c(name).isNotNull()
    return (
        df.filter(known)
        .groupBy(*by, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    )


def running_totals(
    distinct: DataFrame, value: str, names: Sequence[str], by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add running and grand totals of the ``names`` to a table made by :func:`per_value`.

    ``cum_name`` includes the row's own value; ``total_name`` covers the ``by`` group. ``by``
    must hold few distinct groups, such as models, classes or column names.
    """
    by = list(by)
    rest = [name for name in distinct.columns if name not in by]
    placed = _with_value_bucket(distinct, value, [name for name in rest if name != value])

    def directed(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    # One row per bucket and group: small whatever the data.
    of_group = W.partitionBy(*by)
    earlier = of_group.orderBy(directed(_BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        placed.groupBy(*by, _BUCKET)
        .agg(*[F.sum(name).alias(name) for name in names])
        .select(
            *by,
            _BUCKET,
            *[F.sum(name).over(earlier).alias(f"before_{name}") for name in names],
            *[F.sum(name).over(of_group).alias(f"total_{name}") for name in names],
        )
    )
    inside = (
        W.partitionBy(*by, _BUCKET)
        .orderBy(directed(value))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    return placed.join(buckets, [*by, _BUCKET]).select(
        *by,
        *rest,
        *[
            (F.sum(name).over(inside) + F.coalesce(f"before_{name}", F.lit(0))).alias(f"cum_{name}")
            for name in names
        ],
        *[f"total_{name}" for name in names],
    )


def covers(index: Column, cum: Column, n: Column) -> Column:
    """Whether the 0-based sorted position ``index`` falls on a row of ``n`` equal values."""
    return (index >= cum - n) & (index < cum)


def exact_quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation, one column per entry of ``shares``.

    The built-in exact ``percentile`` gathers all distinct values of a group in one task; here
    the order positions are found with :func:`running_totals` instead.
    """
    return quantiles_of(per_value(df, value, {"n": F.lit(1)}, by), value, shares, by)


def quantiles_of(
    distinct: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """:func:`exact_quantiles` from the count ``n`` of each distinct value."""
    counted = running_totals(distinct, value, ["n"], by)
    ends = []
    for name, share in shares.items():
        position = F.lit(share) * (c("total_n") - F.lit(1))
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = covers(index, c("cum_n"), c("n"))
            ends.append(F.max(F.when(here, c(value))).cast("double").alias(f"{side}_{name}"))
        ends.append(F.max(position - F.floor(position)).alias(f"part_{name}"))
    return counted.groupBy(*by).agg(*ends).select(
        *by,
        *[
            (c(f"lo_{name}") + (c(f"hi_{name}") - c(f"lo_{name}")) * c(f"part_{name}")).alias(name)
            for name in shares
        ],
    )


def hashed_rank(
    df: DataFrame, key: str, by: Sequence[str] = (), rank: str = "rank", size: str = "size"
) -> DataFrame:
    """Number the rows of each ``by`` group 1..n in the order of the key's md5.

    The order is random-looking but the same on every run. The leading hex digits of the hash
    are even buckets of that order (4096 or more), so a class with nearly all rows is numbered
    by as many tasks as the table has. ``key`` must be unique. Rows with a NULL in ``by`` are a
    group of their own: every row comes back.
    """
    by = list(by)
    keyed = df.withColumn(_HASH, F.md5(c(key).cast("string")))
    digits = _hash_digits(df.sparkSession)
    keyed = keyed.withColumn(_BUCKET, F.substring(_HASH, 1, digits))
    of_group = W.partitionBy(*by)
    earlier = of_group.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy(*by, _BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *by,
            _BUCKET,
            F.sum("__n").over(earlier).alias("__before"),
            F.sum("__n").over(of_group).alias(size),
        )
    )
    inside = W.partitionBy(*by, _BUCKET).orderBy(_HASH, key)
    told = {name: f"__of_{name}" for name in (*by, _BUCKET)}
    same = reduce(and_, [c(name).eqNullSafe(c(other)) for name, other in told.items()])
    return (
        keyed.join(buckets.withColumnsRenamed(told), same)
        .withColumn(rank, F.row_number().over(inside) + F.coalesce("__before", F.lit(0)))
        .select(*df.columns, rank, size)
    )


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows without replacement, the same on every run: the smallest key hashes."""
    return df.orderBy(F.md5(c(key).cast("string")), key).limit(n)
