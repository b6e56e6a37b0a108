"""Group rates and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import NumericType

from holdfast.functions.bins import ordinal
from holdfast.functions.features import ratio
from holdfast.operators.radix import radix_quantiles

c = F.col


def rate_by(df: DataFrame, key: str, target: str = "churned") -> DataFrame:
    """Mean and count of ``target`` per group; rows without a group are left out."""
    return (
        df.filter(c(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(target).alias("churn_rate"), F.count(target).alias("n_users"))
    )


def rates_by(df: DataFrame, keys: Sequence[str], target: str = "churned") -> DataFrame:
    """``dimension, value, churn_rate, n_users``: :func:`rate_by` for each key, from one scan.

    Each row is counted once per key inside its task; shuffled is one row per value and task.
    """
    names = list(keys)
    grouped = df.groupingSets([[c(name)] for name in names], *map(c, names)).agg(
        F.grouping_id().alias("gid"),
        F.avg(target).alias("churn_rate"),
        F.count(target).alias("n_users"),
    )
    # In a key's set all bits but its own are on.
    all_bits = 2 ** len(names) - 1
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(names):
        own = c("gid") == all_bits - 2 ** (len(names) - 1 - i)
        dimension = F.when(own, name).otherwise(dimension)
        value = F.when(own, c(name).cast("string")).otherwise(value)
    rows = grouped.select(dimension.alias("dimension"), value.alias("value"), "churn_rate", "n_users")
    return rows.filter(c("value").isNotNull())


def label_domain(spark: SparkSession, key: str, labels: Sequence[str]) -> DataFrame:
    """One row per label, in one partition."""
    rows = F.explode(F.array(*[F.lit(label) for label in labels]))
    return spark.range(1).select(rows.alias(key))


def complete(rates: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Group rates over every label of the domain, in its order; empty groups count 0."""
    domain = label_domain(rates.sparkSession, key, labels)
    return (
        domain.join(rates, key, "left")
        .select(
            key,
            ordinal(key, tuple(labels)).alias("position"),
            "churn_rate",
            F.coalesce("n_users", F.lit(0).cast("bigint")).alias("n_users"),
        )
        .orderBy("position")
    )


def shape(df: DataFrame, target: str = "churned") -> DataFrame:
    """Row count, column count and overall rate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.avg(target).alias("churn_rate"),
    )


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Count and share of each value, most frequent first."""
    counts = df.filter(c(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # One row per value: the key is one with few of them.
    everything = F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", ratio(c("n"), everything)).orderBy(F.desc("n"), key)


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, NumericType)]


def _measure_per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate pass over the wide table, turned into one row per column."""
    wide = df.agg(
        *[F.struct(*[fn(name).alias(m) for m, fn in measures.items()]).alias(name) for name in columns]
    )
    tall = wide.unpivot([], list(columns), "column_name", "measured")
    return tall.select("column_name", "measured.*")


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each numeric column."""
    columns = numeric_columns(df)
    moments = _measure_per_column(
        df,
        columns,
        {
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": lambda name: F.min(c(name).cast("double")),
            "max": lambda name: F.max(c(name).cast("double")),
        },
    )
    tall = df.select(*[c(name).cast("double").alias(name) for name in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    quartiles = radix_quantiles(tall, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"])
    return moments.join(quartiles, "column_name", "left").select(
        "column_name", "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Number of unknown values per column."""
    wide = df.agg(*[F.count_if(c(name).isNull()).alias(name) for name in df.columns])
    return wide.unpivot([], df.columns, "column_name", "n_null")


def _pairwise(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair, all in one pass; rows where either is NULL drop out."""

    def one(a: str, b: str) -> Column:
        return F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        F.corr(c(a).cast("double"), c(b).cast("double")).alias("correlation"))

    return df.agg(F.array(*[one(a, b) for a, b in pairs]).alias("pairs")).select(F.inline("pairs"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs of ``columns``; each unordered pair is computed once."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = _pairwise(df, pairs)
    both = F.array(
        F.struct("feature_a", "feature_b", "correlation"),
        F.struct(c("feature_b").alias("feature_a"), c("feature_a").alias("feature_b"), "correlation"),
    )
    one_way = F.slice(both, 1, F.when(c("feature_a") == c("feature_b"), 1).otherwise(2))
    return upper.select(F.inline(one_way))


def comoment_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`correlation_matrix` for many columns: one aggregate, whatever their number.

    A row becomes its pairs of known values inside its task, so a pair counts the rows in which
    both are known, and the plan doesn't grow with the columns. A pair that no row knows has no row.
    """
    values = F.array(*[c(name).cast("double") for name in columns])
    names = F.array(*[F.lit(name) for name in columns])
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(len(columns))),
            lambda i: F.transform(
                F.sequence(i, F.lit(len(columns))),
                lambda j: F.struct(
                    i.alias("i"), j.alias("j"),
                    F.element_at("x", i).alias("a"), F.element_at("x", j).alias("b"),
                ),
            ),
        )
    )
    known = df.select(values.alias("x")).select(F.inline(pairs))
    known = known.filter(c("a").isNotNull() & c("b").isNotNull())
    # A constant has no correlation: F.corr divides by its deviation.
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    upper = known.groupBy("i", "j").agg(
        ratio(F.covar_pop("a", "b"), spread).alias("correlation"), F.count(F.lit(1)).alias("n")
    )
    both = F.array(
        F.struct("i", "j", "correlation", "n"),
        F.struct(c("j").alias("i"), c("i").alias("j"), "correlation", "n"),
    )
    one_way = F.slice(both, 1, F.when(c("i") == c("j"), 1).otherwise(2))
    return upper.select(F.inline(one_way)).select(
        F.element_at(names, c("i")).alias("feature_a"),
        F.element_at(names, c("j")).alias("feature_b"),
        "correlation",
        "n",
    )


def correlation_with(df: DataFrame, target: str) -> DataFrame:
    """Correlation of every numeric column with ``target``, strongest positive first."""
    pairs = [(name, target) for name in numeric_columns(df)]
    return (
        _pairwise(df, pairs)
        .select(c("feature_a").alias("feature"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "feature")
    )


def _per_class(df: DataFrame, by: str, classes: Sequence[int], value: str) -> DataFrame:
    return df.filter(c(by).isin(*classes) & c(value).isNotNull()).select(by, c(value).alias("value"))


def histogram(
    df: DataFrame, value: str, by: str, classes: Sequence[int] = (0, 1), bins: int = 30
) -> DataFrame:
    """Equal-width bins over each class's own range, the last one closed; empty bins count 0.

    The range table has one row per entry of ``classes``, so broadcasting it is bounded.
    """
    rows = _per_class(df, by, classes, value)
    spread = (
        rows.groupBy(by)
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        # A single value gets a range of width one around it.
        .withColumn("pad", F.when(c("lo") == c("hi"), F.lit(0.5)).otherwise(F.lit(0.0)))
        .select(by, (c("lo") - c("pad")).alias("lo"), (c("hi") + c("pad")).alias("hi"))
    )
    counts = (
        rows.join(F.broadcast(spread), by)
        .select(by, F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins)).alias("bin"))
        .groupBy(by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (c("hi") - c("lo")) / F.lit(float(bins))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))
    grid = spread.withColumn("bin", F.explode(numbers))
    return grid.join(counts, [by, "bin"], "left").select(
        by,
        "bin",
        (c("lo") + width * (c("bin") - F.lit(1))).alias("bin_lo"),
        (c("lo") + width * c("bin")).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def boxplot(df: DataFrame, value: str, by: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 quartile ranges) and outlier count per class.

    Four scans find the quartiles and one the rest; no value is shuffled. The quartile table has
    one row per entry of ``classes``, so broadcasting it is bounded.
    """
    rows = _per_class(df, by, classes, value)
    quartiles = radix_quantiles(rows, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    reach = F.lit(1.5) * (c("q3") - c("q1"))
    inside = c("value").between(c("q1") - reach, c("q3") + reach)
    return (
        rows.join(F.broadcast(quartiles), by)
        .groupBy(by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, c("value"))).alias("whisker_lo"),
            F.max(F.when(inside, c("value"))).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
