"""Daily market series. Windows run per asset and hold one row per day."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F

c = F.col

# Start price, window length and days per year of the series.
START_PRICE = 40000.0
VOLATILITY_DAYS = 7
DAYS_PER_YEAR = 365


def price_index(returns: DataFrame, start: float = START_PRICE) -> DataFrame:
    """Price path from compounding the daily log returns."""
    so_far = W.partitionBy("asset").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("price", F.lit(start) * F.exp(F.sum("daily_return").over(so_far)))


def rolling_volatility(returns: DataFrame, days: int = VOLATILITY_DAYS) -> DataFrame:
    """Annualised deviation of the last ``days`` returns, before and after filling the gaps.

    ``raw_volatility`` is NULL until the window is full; ``volatility`` puts the asset's mean
    there.
    """
    last_days = W.partitionBy("asset").orderBy("date").rowsBetween(1 - days, 0)
    full = F.count("daily_return").over(last_days) == days
    deviation = F.stddev_samp("daily_return").over(last_days) * F.lit(math.sqrt(DAYS_PER_YEAR))
    raw = returns.withColumn("raw_volatility", F.when(full, deviation))
    mean = F.avg("raw_volatility").over(W.partitionBy("asset"))
    return raw.withColumn("volatility", F.coalesce("raw_volatility", mean))


def date_spine(rows: DataFrame, day: str, end: date, days: int) -> DataFrame:
    """Each of the last ``days`` days up to ``end`` with its row count, empty days included."""
    start = F.date_sub(F.lit(end), days - 1)
    calendar = rows.sparkSession.range(1).select(
        F.explode(F.sequence(start, F.lit(end))).alias("date")
    )
    counts = (
        rows.filter(c(day).between(start, F.lit(end)))
        .groupBy(c(day).alias("date"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return calendar.join(counts, "date", "left").select(
        "date", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows")
    )
