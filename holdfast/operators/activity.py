"""Per-user activity from the operational tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from holdfast.config import THRESHOLDS, Thresholds
from holdfast.functions import features as f

c = F.col

TRADE, YIELD, ADVANCED, LOGIN = "trade", "yield", "advanced", "login"


def activity_log(trades: DataFrame, yields: DataFrame, advanced: DataFrame) -> DataFrame:
    """Trades and product rows as one tagged log: (user_id, kind, day, amount)."""
    day, amount = F.lit(None).cast("date"), F.lit(None).cast("double")
    traded = trades.select(
        "user_id", F.lit(TRADE).alias("kind"), c("trade_date").alias("day"), c("trade_amount").alias("amount")
    )
    for rows, kind in ((yields, YIELD), (advanced, ADVANCED)):
        traded = traded.unionByName(
            rows.select("user_id", F.lit(kind).alias("kind"), day.alias("day"), amount.alias("amount"))
        )
    return traded


def summarize_activity(log: DataFrame, as_of: date, t: Thresholds = THRESHOLDS) -> DataFrame:
    """One row per user of the log: trade window, product flags, last login.

    All tables meet in one aggregation, so a user with many product rows cannot multiply the
    trades, and everything a very active user did shrinks to one row per map task before the
    only shuffle. The trend compares the last two weeks with the two before; day 14 counts in
    both.

    Nothing after ``as_of`` counts. Product rows have no date in the logical tables, so a product
    counts on any day.
    """
    window_start = F.date_sub(F.lit(as_of), t.trade_window_days)
    recent_start = F.date_sub(F.lit(as_of), t.recent_days)
    prior_start = F.date_sub(F.lit(as_of), t.prior_days)
    day, kind = c("day"), c("kind")
    traded = (kind == TRADE) & day.between(window_start, F.lit(as_of))
    seen = (kind == LOGIN) & (day <= F.lit(as_of))
    recent = F.count_if(traded & (day >= recent_start))
    prior = F.count_if(traded & day.between(prior_start, recent_start))
    return (
        log.filter(kind.isin(YIELD, ADVANCED) | traded | seen)
        .groupBy("user_id")
        .agg(
            F.count_if(traded).alias("trades_30d"),
            F.avg(F.when(traded, c("amount"))).alias("avg_trade_size"),
            f.trade_freq_trend(recent, prior).alias("trade_freq_trend"),
            F.max(f.flag(kind == YIELD)).alias("yield_adoption"),
            F.max(f.flag(kind == ADVANCED)).alias("advanced_trading"),
            F.max(F.when(seen, day)).alias("seen"),
        )
    )


def activity_columns(as_of: date) -> list[str | Column]:
    """Features of a user row joined with its activity summary, which may be absent.

    A login after ``as_of`` is not known on that day.
    """
    login = F.when(c("last_login_date") <= F.lit(as_of), c("last_login_date"))
    return [
        "user_id",
        "segment",
        f.days_until(as_of, "account_created_date").alias("account_age_days"),
        "portfolio_value",
        "n_assets",
        F.coalesce("trades_30d", F.lit(0).cast("bigint")).alias("trades_30d"),
        "avg_trade_size",
        f.days_until(as_of, login).alias("days_since_login"),
        "trade_freq_trend",
        F.coalesce("yield_adoption", F.lit(0)).alias("yield_adoption"),
        F.coalesce("advanced_trading", F.lit(0)).alias("advanced_trading"),
    ]


def activity_features(
    users: DataFrame, log: DataFrame, as_of: date, status: str | None = "active", keep: Sequence[str] = ()
) -> DataFrame:
    """Users with their trade window, login recency and product flags: one row per user.

    Users without activity stay, with no trades and no trend; users who signed up after
    ``as_of`` are left out. The aggregation's shuffle on ``user_id`` serves the join as well.
    ``status`` is the present one: the users table keeps no history of it. ``keep`` names further
    columns of the users to carry along.
    """
    users = users.filter(c("account_created_date") <= F.lit(as_of))
    if status is not None:
        users = users.filter(c("status") == status)
    summary = summarize_activity(log, as_of)
    return users.join(summary, "user_id", "left").select(*activity_columns(as_of), *keep)


def portfolio_return(snapshots: DataFrame, lag_rows: int = 30) -> DataFrame:
    """Percent change of the portfolio against the row ``lag_rows`` snapshots earlier.

    The lag counts rows: it equals days only for gap-free daily snapshots. A user's window
    holds one row per snapshot day, the grain of the table.
    """
    by_day = W.partitionBy("user_id").orderBy("snapshot_date")
    value = c("portfolio_value")
    return snapshots.withColumn("earlier", F.lag(value, lag_rows).over(by_day)).select(
        "user_id",
        "snapshot_date",
        "portfolio_value",
        (f.ratio(value - c("earlier"), c("earlier")) * F.lit(100.0)).alias("portfolio_return_30d"),
    )
