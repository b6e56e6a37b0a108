"""Daily runs on stored state: a day costs that day's rows and one row per user.

The windows of the activity features and the 30-row lag of the portfolio return read 30 days of
rows, or all of them, for each scoring day. Kept as state they need the last state and a few day
folders. Each step writes the folder of its own day and reads only earlier ones, so running a
day again gives the same folder.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from holdfast.config import THRESHOLDS, Thresholds
from holdfast.functions import features as f
from holdfast.sources.stores import read_days, write_day

c = F.col


# The last values of each user, for a lag of many rows


RING_SCHEMA = "user_id BIGINT, ring ARRAY<DOUBLE>, portfolio_value DOUBLE, portfolio_return_30d DOUBLE, day DATE"


def first_ring(snapshots: DataFrame, day: date, path: str, lag: int = 30) -> None:
    """The state after ``day`` from the snapshots up to it: each user's last ``lag`` values."""
    newest = W.partitionBy("user_id").orderBy(F.desc("snapshot_date"))
    last = (
        snapshots.filter(c("snapshot_date") <= F.lit(day))
        .withColumn("age", F.row_number().over(newest))
        .filter(c("age") <= lag)
    )
    aged = F.sort_array(F.collect_list(F.struct((-c("age")).alias("age"), "portfolio_value")))
    unknown = F.lit(None).cast("double")
    state = last.groupBy("user_id").agg(aged.alias("aged")).select(
        "user_id",
        c("aged.portfolio_value").alias("ring"),
        unknown.alias("portfolio_value"),
        unknown.alias("portfolio_return_30d"),
    )
    write_day(state, path, day)


def advance_ring(spark: SparkSession, snapshots: DataFrame, day: date, path: str, lag: int = 30) -> None:
    """The state after ``day``: its snapshots merged into the state of the day before.

    ``snapshots`` are one day's rows. The value ``lag`` rows earlier is the oldest of a full ring.
    A user without a row keeps the ring; its value and return are unknown on that day.
    """
    before = read_days(spark, path, RING_SCHEMA, [day - timedelta(days=1)]).select("user_id", "ring")
    today = snapshots.filter(c("snapshot_date") == F.lit(day)).select("user_id", "portfolio_value")
    both = before.join(today, "user_id", "full")
    ring = F.coalesce("ring", F.array().cast("array<double>"))
    value = c("portfolio_value")
    earlier = F.when(F.size(ring) >= lag, F.get(ring, F.lit(0)))
    longer = F.concat(ring, F.array(value))
    kept = F.when(F.size(longer) > lag, F.slice(longer, F.size(longer) - lag + 1, F.lit(lag))).otherwise(longer)
    state = both.select(
        "user_id",
        F.when(value.isNull(), ring).otherwise(kept).alias("ring"),
        "portfolio_value",
        (f.ratio(value - earlier, earlier) * F.lit(100.0)).alias("portfolio_return_30d"),
    )
    write_day(state, path, day)


def returns_of(spark: SparkSession, path: str, days: list[date]) -> DataFrame:
    """The returns that the steps of ``days`` found."""
    rows = read_days(spark, path, RING_SCHEMA, days).filter(c("portfolio_value").isNotNull())
    return rows.select("user_id", c("day").alias("snapshot_date"), "portfolio_value", "portfolio_return_30d")


# Counts of sliding windows


DELTA_SCHEMA = "user_id BIGINT, trades BIGINT, amount DOUBLE, day DATE"
WINDOW_SCHEMA = "user_id BIGINT, trades BIGINT, amount DOUBLE, recent BIGINT, prior BIGINT, day DATE"
_COUNTS = ("trades", "amount", "recent", "prior")


def daily_trades(trades: DataFrame) -> DataFrame:
    """What each user adds on a day: number and amount of trades."""
    return trades.groupBy("user_id", c("trade_date").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("trade_amount").alias("amount")
    )


def window_changes(day: date, t: Thresholds = THRESHOLDS) -> list[tuple[date, str, int]]:
    """``day folder, count, +1 or -1``: what enters the windows on ``day`` and what leaves them.

    The windows hold both their ends, so the last two weeks and the two before share a day.
    """

    def back(days: int) -> date:
        return day - timedelta(days=days)

    changes = []
    for name in ("trades", "amount"):
        changes += [(day, name, 1), (back(t.trade_window_days + 1), name, -1)]
    changes += [(day, "recent", 1), (back(t.recent_days + 1), "recent", -1)]
    changes += [(back(t.recent_days), "prior", 1), (back(t.prior_days + 1), "prior", -1)]
    return changes


def first_windows(deltas: DataFrame, day: date, path: str, t: Thresholds = THRESHOLDS) -> None:
    """The state after ``day`` from the window's days."""

    def within(newest: int, oldest: int) -> Column:
        return c("day").between(F.date_sub(F.lit(day), oldest), F.date_sub(F.lit(day), newest))

    state = deltas.filter(within(0, t.trade_window_days)).groupBy("user_id").agg(
        F.sum("trades").alias("trades"),
        F.sum("amount").alias("amount"),
        F.sum(F.when(within(0, t.recent_days), c("trades")).otherwise(0)).alias("recent"),
        F.sum(F.when(within(t.recent_days, t.prior_days), c("trades")).otherwise(0)).alias("prior"),
    )
    write_day(state, path, day)


def advance_windows(
    spark: SparkSession, deltas: str, day: date, path: str, t: Thresholds = THRESHOLDS
) -> None:
    """The state after ``day``: the day before's, plus what enters, less what leaves.

    Five day folders of ``deltas`` are read. A user whose windows are empty leaves the state.
    """
    changes = window_changes(day, t)
    moved = read_days(spark, deltas, DELTA_SCHEMA, sorted({at for at, _, _ in changes}))
    total = {}
    for name in _COUNTS:
        source = "amount" if name == "amount" else "trades"
        total[name] = sum(
            (F.when(c("day") == F.lit(at), c(source) * F.lit(sign)).otherwise(F.lit(0)))
            for at, of, sign in changes if of == name
        )
    moved = moved.select("user_id", *[column.alias(name) for name, column in total.items()])
    before = read_days(spark, path, WINDOW_SCHEMA, [day - timedelta(days=1)]).select("user_id", *_COUNTS)
    state = (
        before.unionByName(moved)
        .groupBy("user_id")
        .agg(*[F.sum(name).alias(name) for name in _COUNTS])
        .filter(c("trades") > 0)
    )
    write_day(state, path, day)


def windows_of(spark: SparkSession, path: str, days: list[date]) -> DataFrame:
    """The activity features of the stored windows."""
    rows = read_days(spark, path, WINDOW_SCHEMA, days)
    return rows.select(
        "day",
        "user_id",
        c("trades").alias("trades_30d"),
        f.ratio(c("amount"), c("trades")).alias("avg_trade_size"),
        f.trade_freq_trend(c("recent"), c("prior")).alias("trade_freq_trend"),
    )
