"""User features and scores as column expressions.

Comparisons with NULL are never true, and a flag built on one is 0, not NULL: a missing trend
neither raises nor lowers a flag. Ratios are DOUBLE and NULL where the denominator is 0.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from holdfast.config import (
    ACCOUNT_STAGE,
    LOGISTIC,
    RISK_SEGMENT_LABELS,
    RULE_PRIOR,
    THRESHOLDS,
    TIER_LABELS,
    VALUE_SEGMENT,
    LogisticWeights,
    RulePrior,
    Thresholds,
)
from holdfast.functions.bins import right_closed

c = F.col


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """DOUBLE quotient, NULL on a zero denominator (ANSI division would raise)."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def days_until(as_of: date, day: str | Column) -> Column:
    """Whole days from ``day`` to the reference date."""
    return F.datediff(F.lit(as_of), day)


def trade_freq_trend(recent: Column, prior: Column) -> Column:
    """Relative change of the trade count against the window before it."""
    return ratio(recent - prior, prior)


def trading_intensity() -> Column:
    """Weekly trades, damped by the account's age in weeks."""
    return ratio(c("trades_30d") / F.lit(4.3), F.log1p(c("account_age_days") / F.lit(7.0)))


def portfolio_concentration() -> Column:
    return ratio(F.lit(1.0), c("n_assets"))


def engagement_score(t: Thresholds = THRESHOLDS) -> Column:
    """0 to 5: recent login counts double, trading and the two products count once each."""
    return (
        flag(c("days_since_login") < t.idle_days) * F.lit(2)
        + flag(c("trades_30d") > t.active_trades)
        + c("yield_adoption")
        + c("advanced_trading")
    )


def lapsed_or_declining(t: Thresholds = THRESHOLDS) -> Column:
    return (c("days_since_login") > t.lapsed_days) | (c("trade_freq_trend") < t.declining_trend)


def high_risk_profile(t: Thresholds = THRESHOLDS) -> Column:
    return flag(lapsed_or_declining(t) | (c("n_assets") == 1))


def account_stage() -> Column:
    return right_closed("account_age_days", ACCOUNT_STAGE)


def value_segment() -> Column:
    return right_closed("portfolio_value", VALUE_SEGMENT)


def risk_tier(labels: tuple[str, str, str] = TIER_LABELS, t: Thresholds = THRESHOLDS) -> Column:
    """Worst matching tier; ``labels`` run from worst to best."""
    worst, middle, best = labels
    return (
        F.when(lapsed_or_declining(t), F.lit(worst))
        .when(
            (c("days_since_login") > t.idle_days) | (c("engagement_score") < t.low_engagement),
            F.lit(middle),
        )
        .otherwise(F.lit(best))
    )


def risk_segment(t: Thresholds = THRESHOLDS) -> Column:
    return risk_tier(RISK_SEGMENT_LABELS, t)


def _size_of_loss(value: Column) -> Column:
    """|min(value, 0)|. LEAST skips NULL and would turn an unknown value into 0."""
    return F.when(value.isNotNull(), F.abs(F.least(value, F.lit(0.0))))


def value_engagement_ratio() -> Column:
    return ratio(c("portfolio_value"), c("engagement_score") + F.lit(1))


def inactivity_decline_risk() -> Column:
    return c("days_since_login") * _size_of_loss(c("trade_freq_trend"))


def concentration_loss() -> Column:
    return c("portfolio_concentration") * _size_of_loss(c("portfolio_return_30d"))


def churn_probability(w: LogisticWeights = LOGISTIC, null_trend: float | None = None) -> Column:
    """Logistic score. An unknown trend makes the score unknown, unless ``null_trend`` stands in."""
    trend = c("trade_freq_trend")
    if null_trend is not None:
        trend = F.coalesce(trend, F.lit(float(null_trend)))
    logit = (
        F.lit(w.intercept)
        + c("days_since_login") * F.lit(w.days_since_login)
        + trend * F.lit(w.trade_freq_trend)
        + c("engagement_score") * F.lit(w.engagement_score)
        + c("high_risk_profile") * F.lit(w.high_risk_profile)
        + c("portfolio_concentration") * F.lit(w.portfolio_concentration)
        + c("yield_adoption") * F.lit(w.yield_adoption)
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def rule_churn_prior(p: RulePrior = RULE_PRIOR, t: Thresholds = THRESHOLDS) -> Column:
    """Rule-based churn prior of a user, capped; NULL for a segment without a base rate."""
    base = F.lit(None).cast("double")
    for name, rate in p.base.items():
        base = F.when(c("segment") == name, F.lit(rate)).otherwise(base)
    login = (
        F.when(c("days_since_login") > t.lapsed_days, F.lit(p.lapsed))
        .when(c("days_since_login") > t.idle_days, F.lit(p.idle))
        .otherwise(F.lit(0.0))
    )
    total = (
        base
        + login
        + flag(c("trade_freq_trend") < t.declining_trend) * F.lit(p.declining)
        + flag(c("yield_adoption") == 0) * F.lit(p.no_yield)
        + flag(c("n_assets") == 1) * F.lit(p.single_asset)
        + flag(c("portfolio_return_30d") < p.loss_below) * F.lit(p.loss)
    )
    return F.when(total.isNotNull(), F.least(F.lit(p.ceiling), total))


def recommended_intervention(t: Thresholds = THRESHOLDS) -> Column:
    """First matching campaign. Campaign names and value floors."""
    drifting = c("days_since_login").between(t.idle_days, t.lapsed_days)
    return (
        F.when(
            drifting & (c("yield_adoption") == 0) & (c("portfolio_value") > 1000),
            F.lit("yield_product_education"),
        )
        .when(drifting, F.lit("general_reengagement"))
        .when((c("n_assets") == 1) & (c("portfolio_value") > 500), F.lit("diversification_education"))
        .when(c("trade_freq_trend") < t.steep_decline, F.lit("market_insights_content"))
        .otherwise(F.lit("standard_retention"))
    )


def intervention_priority() -> Column:
    """Risk and portfolio size, weighted. 0.6, 0.4, 10000."""
    return c("churn_probability") * F.lit(0.6) + c("portfolio_value") / F.lit(10000.0) * F.lit(0.4)
