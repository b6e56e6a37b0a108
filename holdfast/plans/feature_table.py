"""The wide feature table from the operational tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, functions as F

from holdfast.functions import features as f
from holdfast.operators.activity import activity_features, portfolio_return

c = F.col

# What an unknown value becomes: no trades in the window, no trend, no snapshot 30 days back.
FILLS = {"avg_trade_size": 0.0, "trade_freq_trend": 0.0, "portfolio_return_30d": 0.0}


def add_derived_features(base: DataFrame) -> DataFrame:
    """Append the five derived columns of the feature table."""
    return base.withColumns(
        {
            "trading_intensity": f.trading_intensity(),
            "portfolio_concentration": f.portfolio_concentration(),
            "engagement_score": f.engagement_score(),
            "high_risk_profile": f.high_risk_profile(),
            "account_stage": f.account_stage(),
        }
    )


def user_features(
    users: DataFrame,
    log: DataFrame,
    snapshots: DataFrame,
    as_of: date,
    fills: Mapping[str, float] = FILLS,
) -> DataFrame:
    """One row per user known on ``as_of``, with the computed 30-day return and the label.

    A user without a login so far counts as away since sign-up. The operational tables have no
    ``volatility_sensitivity``; a model on this table leaves it out.
    """
    base = activity_features(users, log, as_of, status=None, keep=["status"])
    returns = (
        portfolio_return(snapshots.filter(c("snapshot_date") <= F.lit(as_of)))
        .filter(c("snapshot_date") == F.lit(as_of))
        .select("user_id", "portfolio_return_30d")
    )
    known = base.join(returns, "user_id", "left").withColumns(
        {
            "days_since_login": F.coalesce("days_since_login", "account_age_days").cast("double"),
            "churned": f.flag(c("status") == "churned"),
        }
    )
    return add_derived_features(known.drop("status").fillna(dict(fills)))
