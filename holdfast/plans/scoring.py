"""Daily churn scoring and the rule-based views of the same features."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from holdfast.config import LOGISTIC, LogisticWeights
from holdfast.functions import features as f

c = F.col


def daily_scores(
    features: DataFrame,
    as_of: date,
    weights: LogisticWeights = LOGISTIC,
    null_trend: float | None = None,
) -> DataFrame:
    """The score row of every user in the activity features, as the score store keeps it.

    A user without trades in the prior window has no trend and so no probability, but does
    get a tier. ``null_trend`` replaces the missing trend in the probability only.
    """
    flagged = features.withColumns(
        {
            "engagement_score": f.engagement_score(),
            "high_risk_profile": f.high_risk_profile(),
            "portfolio_concentration": f.portfolio_concentration(),
        }
    )
    return flagged.select(
        "user_id",
        f.churn_probability(weights, null_trend).alias("churn_probability"),
        f.risk_tier().alias("risk_tier"),
        "days_since_login",
        "trade_freq_trend",
        "engagement_score",
        "trades_30d",
        "yield_adoption",
        "n_assets",
        "portfolio_value",
        F.lit(as_of).cast("timestamp_ntz").alias("scored_at"),
    )


def model_scores(model: Transformer, features: DataFrame, as_of: date) -> DataFrame:
    """The score row of every user by a fitted model instead of the published weights.

    ``model`` takes rows of the wide feature table, as :meth:`Training.full_model` does.
    """
    rows = model.transform(interaction_features(features))
    return rows.select(
        "user_id",
        vector_to_array("probability")[1].alias("churn_probability"),
        f.risk_tier().alias("risk_tier"),
        c("days_since_login").cast("int").alias("days_since_login"),
        "trade_freq_trend",
        "engagement_score",
        "trades_30d",
        "yield_adoption",
        "n_assets",
        "portfolio_value",
        F.lit(as_of).cast("timestamp_ntz").alias("scored_at"),
    )


def scoring_report(scores: DataFrame) -> DataFrame:
    """Scores, most at risk first, unknown ones last.

    The id breaks ties, which also lets the range shuffle split the long run of equal or
    unknown probabilities over many tasks.
    """
    return scores.select(
        "user_id", "churn_probability", "risk_tier", "days_since_login", "engagement_score", "scored_at"
    ).orderBy(F.desc_nulls_last("churn_probability"), "user_id")


def interaction_features(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "value_engagement_ratio": f.value_engagement_ratio(),
            "inactivity_decline_risk": f.inactivity_decline_risk(),
            "concentration_loss": f.concentration_loss(),
        }
    )


def user_segments(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {"risk_segment": f.risk_segment(), "value_segment": f.value_segment()}
    )
