"""The logical tables, bound to the parquet files of one folder.

Each method returns a lazy DataFrame with the logical schema; all casts live here. The bound
files carry no time zone, so scoring times stay TIMESTAMP_NTZ and no result depends on the
session's zone.

Nothing here joins on a raw event key: events are aggregated per user (map side first) before
they meet the user table, so a user with a third of all events costs one row per map task.
"""

from __future__ import annotations

import os
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from holdfast.config import AS_OF, LOGISTIC
from holdfast.functions import features as f
from holdfast.operators.activity import (
    ADVANCED,
    LOGIN,
    TRADE,
    YIELD,
    activity_columns,
    summarize_activity,
)
from holdfast.plans.feature_table import add_derived_features
from holdfast.plans.scoring import daily_scores

c = F.col

SNAPSHOTS_FROM = date(2023, 12, 1)
SCORE_SHIFT_DAYS = 40

# Market segments of the bound customers and the user segment each stands for.
SEGMENT_OF = {"AUTOMOBILE": "whale", "MACHINERY": "power_user", "BUILDING": "active"}

# Columns of the bound files. A given schema saves a footer-reading job per scan.
RAW_SCHEMAS = {
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
        " props STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
        " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
        " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}

USER_FEATURES_SCHEMA = (
    "user_id BIGINT, segment STRING, account_age_days INT, portfolio_value DOUBLE, n_assets INT, "
    "trades_30d BIGINT, avg_trade_size DOUBLE, days_since_login DOUBLE, trade_freq_trend DOUBLE, "
    "yield_adoption INT, advanced_trading INT, volatility_sensitivity DOUBLE, "
    "portfolio_return_30d DOUBLE, churned INT, trading_intensity DOUBLE, "
    "portfolio_concentration DOUBLE, engagement_score INT, high_risk_profile INT, "
    "account_stage STRING"
)


def uniform_from(id_col: str) -> Column:
    """Reproducible number in [0, 1) from the first 8 hex digits of the id's md5."""
    digits = F.substring(F.md5(c(id_col).cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


class Tables:
    """Logical tables over ``<folder>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str, as_of: date = AS_OF) -> None:
        self.spark = spark
        self.folder = folder
        self.as_of = as_of

    def raw(self, name: str) -> DataFrame:
        path = os.path.join(self.folder, f"{name}.parquet")
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(path)

    def version(self, name: str) -> tuple[int, int]:
        """Newest change and total size of a table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, f"{name}.parquet"))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(path)
        return max([f.getModificationTime() for f in found], default=0), sum(f.getLen() for f in found)

    def _events(self, *conditions: Column) -> DataFrame:
        rows = self.raw("events")
        for condition in conditions:
            rows = rows.filter(condition)
        return rows

    def _days_back(self, days: Column) -> Column:
        return F.date_sub(F.lit(self.as_of), days.cast("int"))

    def _user_columns(self) -> dict[str, Column]:
        """User attributes from a customer row and the day the user was last ``seen``."""
        key = c("user_id")
        churned = key % 7 == 0
        created = self._days_back(F.lit(1) + key * 37 % 730)
        return {
            "email": c("c_name"),
            "segment": c("c_mktsegment"),
            "account_created_date": created,
            "portfolio_value": c("c_acctbal") * F.lit(10.0),
            "n_assets": (F.lit(1) + c("c_nationkey") % 10).cast("int"),
            "last_login_date": F.coalesce("seen", self._days_back(key % 60)),
            "status": F.when(churned, "churned").otherwise("active"),
            "churned_date": F.when(churned, F.greatest(created, self._days_back(key % 45))),
        }

    def _customers(self) -> DataFrame:
        return self.raw("customer").withColumnRenamed("c_custkey", "user_id")

    def users(self) -> DataFrame:
        """One row per user. The login join vanishes from plans that do not read the column."""
        login = (
            self._events(c("event_type") == "view", c("value") > 50.0, F.to_date("ts") <= F.lit(self.as_of))
            .groupBy("user_id")
            .agg(F.max(F.to_date("ts")).alias("seen"))
        )
        columns = self._user_columns()
        return (
            self._customers()
            .join(login, "user_id", "left")
            .select("user_id", *[column.alias(name) for name, column in columns.items()])
        )

    def trades(self) -> DataFrame:
        return self._events(c("event_type") == "purchase").select(
            c("event_id").alias("trade_id"),
            "user_id",
            c("value").alias("trade_amount"),
            F.to_date("ts").alias("trade_date"),
        )

    def yield_products(self) -> DataFrame:
        """User × product: a user may appear many times."""
        return self._events(c("event_type") == "signup", c("value") > 100.0).select("user_id")

    def advanced_trading_users(self) -> DataFrame:
        return self._events(c("event_type") == "click", c("value") > 150.0).select("user_id").distinct()

    def interventions(self) -> DataFrame:
        return self._events(c("event_type") == "click", c("value") > 100.0).select(
            "user_id", F.to_date("ts").alias("intervention_date")
        )

    def enrollments(self) -> DataFrame:
        """User × test. Who takes part, in which arm and since when is derived from the id."""
        key = c("c_custkey")
        return (
            self.raw("customer")
            .filter(key % 3 != 0)
            .select(
                key.alias("user_id"),
                F.when(key % 5 == 0, "other").otherwise("yield_education_intervention").alias("test_name"),
                F.when(key % 2 == 0, "control").otherwise("treatment").alias("variant"),
                self._days_back(key % 80).alias("enrolled_date"),
            )
        )

    def snapshots(self) -> DataFrame:
        """User × day portfolio values, gap-free, for every user with events.

        The running window holds one row per day of the snapshot range, however many events a
        user has: they are summed per day first. Gains before the first snapshot day count on it.
        """
        day = F.greatest(F.to_date("ts"), F.lit(SNAPSHOTS_FROM))
        daily = (
            self._events(F.to_date("ts") <= F.lit(self.as_of))
            .groupBy("user_id", day.alias("snapshot_date"))
            .agg(F.sum("value").alias("gain"))
        )
        days = F.sequence(F.lit(SNAPSHOTS_FROM), F.lit(self.as_of))
        calendar = (
            daily.select("user_id").distinct().select("user_id", F.explode(days).alias("snapshot_date"))
        )
        so_far = W.partitionBy("user_id").orderBy("snapshot_date").rowsBetween(W.unboundedPreceding, 0)
        gains = calendar.join(daily, ["user_id", "snapshot_date"], "left").select(
            "user_id",
            "snapshot_date",
            F.sum(F.coalesce("gain", F.lit(0.0))).over(so_far).alias("gained"),
        )
        start = self.users().select("user_id", F.greatest("portfolio_value", F.lit(0.0)).alias("start"))
        return gains.join(start, "user_id").select(
            "user_id", "snapshot_date", (c("start") + c("gained")).alias("portfolio_value")
        )

    def logged_scores(self) -> DataFrame:
        """Old scores, for monitoring them against the outcome."""
        return self._events(c("event_type") == "error").select(
            "user_id",
            F.least(c("value") / F.lit(200.0), F.lit(1.0)).alias("churn_probability"),
            F.when(c("value") > 70, "high").when(c("value") > 30, "medium").otherwise("low").alias("risk_tier"),
            (c("ts") - F.expr(f"INTERVAL '{SCORE_SHIFT_DAYS}' DAY")).alias("scored_at"),
        )

    def activity_log(self) -> DataFrame:
        """Trades, product rows and logins as one log, read in a single scan of the events."""
        value = c("value")
        kinds = {
            TRADE: c("event_type") == "purchase",
            YIELD: (c("event_type") == "signup") & (value > 100.0),
            ADVANCED: (c("event_type") == "click") & (value > 150.0),
            LOGIN: (c("event_type") == "view") & (value > 50.0),
        }
        kind = F.coalesce(*[F.when(condition, name) for name, condition in kinds.items()])
        return self._events(reduce(or_, kinds.values())).select(
            "user_id", kind.alias("kind"), F.to_date("ts").alias("day"), value.alias("amount")
        )

    def activity(self, status: str | None = "active", as_of: date | None = None) -> DataFrame:
        """Activity features on ``as_of``: one scan, shuffle and join of the events."""
        as_of = as_of or self.as_of
        summary = summarize_activity(self.activity_log(), as_of)
        users = self._customers().join(summary, "user_id", "left").withColumns(self._user_columns())
        users = users.filter(c("account_created_date") <= F.lit(as_of))
        if status is not None:
            users = users.filter(c("status") == status)
        return users.select(*activity_columns(as_of))

    def scores_on(self, as_of: date, null_trend: float | None = None) -> DataFrame:
        return daily_scores(self.activity(as_of=as_of), as_of, null_trend=null_trend)

    def recent_scores(self) -> DataFrame:
        """The scoring runs of the reference date and the day before, stacked."""
        return self.scores_on(self.as_of - timedelta(days=1)).unionByName(self.scores_on(self.as_of))

    def user_features(self) -> DataFrame:
        """The wide feature table: 14 base and 5 derived columns, one row per user."""
        key = c("user_id")
        segment = F.lit("casual")
        for market, name in SEGMENT_OF.items():
            segment = F.when(c("segment") == market, name).otherwise(segment)
        base = self.activity(status=None).select(
            "user_id",
            segment.alias("segment"),
            c("account_age_days").cast("int").alias("account_age_days"),
            "portfolio_value",
            "n_assets",
            "trades_30d",
            F.coalesce("avg_trade_size", F.lit(0.0)).alias("avg_trade_size"),
            c("days_since_login").cast("double").alias("days_since_login"),
            F.coalesce("trade_freq_trend", F.lit(0.0)).alias("trade_freq_trend"),
            "yield_adoption",
            "advanced_trading",
            F.round(key * 17 % 600 / F.lit(100.0) - F.lit(3.0), 3).alias("volatility_sensitivity"),
            F.round(key * 13 % 600 / F.lit(10.0) - F.lit(30.0), 2).alias("portfolio_return_30d"),
            f.flag(key % 7 == 0).alias("churned"),
        )
        return add_derived_features(base)

    def learnable_user_features(self) -> DataFrame:
        """``user_features`` with a label that follows the rule prior, so models can learn it."""
        label = f.flag(f.rule_churn_prior() > uniform_from("user_id"))
        return self.user_features().withColumn("churned", label)

    def scorers(self) -> DataFrame:
        """The published logit and the rule prior as two models of the feature table's label.

        Scores are rounded, so that equal inputs tie whatever the last bits of an exponential.
        """
        rows = self.user_features()
        each = F.inline(
            F.array(
                F.struct(F.lit("published_logit").alias("model"), f.churn_probability(LOGISTIC, None).alias("raw")),
                F.struct(F.lit("rule_prior").alias("model"), f.rule_churn_prior().alias("raw")),
            )
        )
        score = F.round(F.round("raw", 10), 6)
        return rows.select("user_id", c("churned").alias("label"), each).select(
            "model", "user_id", "label", score.alias("score"), f.flag(score >= 0.5).alias("prediction")
        )

    def scored(self) -> DataFrame:
        """Labelled scores with heavy ties, for the metric reports."""
        score = F.round(c("l_discount") * F.lit(5.0) + c("l_quantity") / F.lit(100.0), 2)
        return self.raw("lineitem").select(
            f.flag(c("l_returnflag") == "R").alias("label"),
            score.alias("score"),
            f.flag(score >= 0.5).alias("prediction"),
        )

    def market_returns(self) -> DataFrame:
        """Daily return of one asset."""
        return (
            self.raw("events")
            .groupBy(F.to_date("ts").alias("date"))
            .agg(((F.avg("value") - F.lit(50.0)) / F.lit(1000.0)).alias("daily_return"))
            .select(F.lit("market").alias("asset"), "date", "daily_return")
        )

