"""Every threshold, coefficient and label set, in one place.

The numbers below are fixed values of the scoring rules; the rest of the package takes them
as arguments and never repeats them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Reference date of the bound tables. A production job passes its own run date.
AS_OF = date(2024, 1, 31)


@dataclass(frozen=True)
class Thresholds:
    """Limits of the activity rules."""

    lapsed_days: int = 14
    idle_days: int = 7
    declining_trend: float = -0.3
    steep_decline: float = -0.5
    active_trades: int = 5
    low_engagement: int = 2
    trade_window_days: int = 30
    recent_days: int = 14
    prior_days: int = 28


@dataclass(frozen=True)
class LogisticWeights:
    """The published churn logit."""

    intercept: float = -2.5
    days_since_login: float = 0.15
    trade_freq_trend: float = -0.8
    engagement_score: float = -0.5
    high_risk_profile: float = 1.2
    portfolio_concentration: float = 0.3
    yield_adoption: float = -0.4


@dataclass(frozen=True)
class RulePrior:
    """Additive churn prior, base rate by segment plus one step per warning sign."""

    base: dict[str, float] = field(
        default_factory=lambda: {"casual": 0.35, "active": 0.15, "power_user": 0.05, "whale": 0.03}
    )
    lapsed: float = 0.4
    idle: float = 0.2
    declining: float = 0.15
    no_yield: float = 0.1
    single_asset: float = 0.1
    loss: float = 0.1
    loss_below: float = -10.0
    ceiling: float = 0.95


@dataclass(frozen=True)
class Bins:
    """Right-closed intervals (edges[i], edges[i+1]] and their labels."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]


THRESHOLDS = Thresholds()
LOGISTIC = LogisticWeights()
RULE_PRIOR = RulePrior()

# Interval edges and labels.
ACCOUNT_STAGE = Bins((0, 30, 90, 180, 365, 730), ("new", "growing", "established", "mature", "veteran"))
AGE_BUCKET = Bins((0, 30, 90, 180, 365, 730), ("0-30d", "31-90d", "91-180d", "181-365d", "365+d"))
VALUE_SEGMENT = Bins((0, 1000, 10000, 50000, float("inf")), ("small", "medium", "large", "whale"))

# Tier labels of the score table and of the analysis segments, worst first.
TIER_LABELS = ("high", "medium", "low")
RISK_SEGMENT_LABELS = ("high_risk", "medium_risk", "low_risk")

# Names and order of the model inputs.
CATEGORICAL = ("segment", "account_stage")
MODEL_FEATURES = (
    "trades_30d", "avg_trade_size", "trading_intensity", "trade_freq_trend",
    "account_age_days", "portfolio_value", "n_assets", "portfolio_concentration",
    "days_since_login", "engagement_score", "yield_adoption", "advanced_trading",
    "volatility_sensitivity", "portfolio_return_30d", "high_risk_profile",
    "segment_encoded", "account_stage_encoded",
)

# Columns of the correlation heat map.
HEATMAP_FEATURES = (
    "churned", "days_since_login", "trade_freq_trend", "engagement_score",
    "trades_30d", "n_assets", "yield_adoption", "portfolio_value",
)
