"""Edges of the feature, scoring and campaign rules, by hand."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from holdfast.bindings import add_derived_features
from holdfast.config import ACCOUNT_STAGE, VALUE_SEGMENT, LogisticWeights
from holdfast.functions import features as f
from holdfast.functions.bins import right_closed
from holdfast.operators.activity import activity_features, activity_log, portfolio_return
from holdfast.plans import campaigns
from holdfast.plans.scoring import daily_scores, interaction_features, user_segments

D = date(2024, 1, 31)


def back(days):
    return D - timedelta(days=days)


def users(spark, rows):
    """(id, created days ago, value, assets, login days ago, churned days ago or None)"""
    return spark.createDataFrame(
        [
            (
                i, f"u{i}", "casual", back(created), float(value), assets, back(login),
                "active" if churned is None else "churned",
                None if churned is None else back(churned),
            )
            for i, created, value, assets, login, churned in rows
        ],
        "user_id BIGINT, email STRING, segment STRING, account_created_date DATE,"
        " portfolio_value DOUBLE, n_assets INT, last_login_date DATE, status STRING,"
        " churned_date DATE",
    )


def trades(spark, rows):
    return spark.createDataFrame(
        [(n, u, 10.0, back(days)) for n, (u, days) in enumerate(rows)],
        "trade_id BIGINT, user_id BIGINT, trade_amount DOUBLE, trade_date DATE",
    )


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "user_id BIGINT")


def features(u, traded, yields, advanced, status="active"):
    return activity_features(u, activity_log(traded, yields, advanced), D, status)


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "value, bins, label",
    [
        (30, ACCOUNT_STAGE, "new"),
        (31, ACCOUNT_STAGE, "growing"),
        (90, ACCOUNT_STAGE, "growing"),
        (730, ACCOUNT_STAGE, "veteran"),
        (731, ACCOUNT_STAGE, None),
        (0, ACCOUNT_STAGE, None),
        (0, VALUE_SEGMENT, None),
        (1000, VALUE_SEGMENT, "small"),
        (1000.01, VALUE_SEGMENT, "medium"),
        (None, VALUE_SEGMENT, None),
    ],
)
def test_bins_close_on_the_right(spark, value, bins, label):
    row = spark.range(1).select(right_closed(F.lit(value).cast("double"), bins).alias("x"))
    assert only(row).x == label


def test_products_do_not_multiply_trades(spark):
    u = users(spark, [(1, 100, 500, 2, 3, None)])
    row = only(features(u, trades(spark, [(1, 2), (1, 20)]), ids(spark, [1, 1, 1]), ids(spark, [1])))
    assert row.trades_30d == 2
    assert (row.yield_adoption, row.advanced_trading) == (1, 1)
    assert row.account_age_days == 100


def test_day_fourteen_counts_in_both_windows(spark):
    u = users(spark, [(1, 100, 500, 2, 3, None)])
    none = ids(spark, [])
    assert only(features(u, trades(spark, [(1, 14)]), none, none)).trade_freq_trend == 0.0


def test_no_prior_trades_means_no_trend_and_no_probability(spark):
    u = users(spark, [(1, 100, 500, 2, 3, None)])
    none = ids(spark, [])
    row = only(daily_scores(features(u, trades(spark, [(1, 5), (1, 13)]), none, ids(spark, [1])), D))
    assert row.trade_freq_trend is None and row.churn_probability is None
    assert row.engagement_score == 3 and row.risk_tier == "low"
    filled = only(
        daily_scores(features(u, trades(spark, [(1, 5)]), none, ids(spark, [1])), D, null_trend=0.0)
    )
    assert filled.churn_probability is not None and filled.trade_freq_trend is None


def test_users_without_activity_stay_and_churned_users_go(spark):
    u = users(spark, [(1, 100, 500, 2, 3, None), (2, 100, 500, 2, 3, 10)])
    none = ids(spark, [])
    row = only(features(u, trades(spark, []), none, none))
    assert (row.user_id, row.trades_30d, row.avg_trade_size, row.yield_adoption) == (1, 0, None, 0)
    assert features(u, trades(spark, []), none, none, status=None).count() == 2


def test_logistic_score(spark):
    row = spark.range(1).select(
        F.lit(1).alias("days_since_login"),
        *[
            F.lit(0.0).alias(name)
            for name in (
                "trade_freq_trend", "engagement_score", "high_risk_profile",
                "portfolio_concentration", "yield_adoption",
            )
        ],
    )
    assert only(row.select(f.churn_probability().alias("p"))).p == pytest.approx(0.087066, abs=1e-6)
    flat = LogisticWeights(intercept=0.0, days_since_login=0.0)
    assert only(row.select(f.churn_probability(flat).alias("p"))).p == 0.5


def wide(spark, **values):
    base = {
        "account_age_days": 100, "portfolio_value": 2000.0, "n_assets": 2, "trades_30d": 6,
        "days_since_login": 1.0, "trade_freq_trend": 0.0, "yield_adoption": 0,
        "advanced_trading": 0, "portfolio_return_30d": 0.0, "segment": "casual",
    }
    base.update(values)
    types = {"trade_freq_trend": "double", "portfolio_return_30d": "double", "days_since_login": "double"}
    return spark.range(1).select(
        *[F.lit(v).cast(types[k]).alias(k) if k in types else F.lit(v).alias(k) for k, v in base.items()]
    )


def test_unknown_values_leave_flags_at_zero(spark):
    row = only(add_derived_features(wide(spark, trade_freq_trend=None, days_since_login=None)))
    assert row.high_risk_profile == 0
    assert row.engagement_score == 1


def test_unknown_trend_is_not_a_zero_interaction(spark):
    row = only(interaction_features(add_derived_features(wide(spark, trade_freq_trend=None))))
    assert row.inactivity_decline_risk is None
    gain = only(interaction_features(add_derived_features(wide(spark, portfolio_return_30d=5.0))))
    loss = only(interaction_features(add_derived_features(wide(spark, portfolio_return_30d=-5.0))))
    assert (gain.concentration_loss, loss.concentration_loss) == (0.0, 2.5)


@pytest.mark.parametrize(
    "values, segment",
    [
        ({"days_since_login": 14.1}, "high_risk"),
        ({"days_since_login": 14.0}, "medium_risk"),
        ({"trade_freq_trend": -0.31}, "high_risk"),
        ({"days_since_login": 7.0, "yield_adoption": 1}, "low_risk"),
        ({"days_since_login": 7.0}, "medium_risk"),
        ({}, "low_risk"),
    ],
)
def test_risk_segments(spark, values, segment):
    row = only(user_segments(add_derived_features(wide(spark, **values))))
    assert row.risk_segment == segment


def test_rule_prior_is_capped(spark):
    worst = wide(
        spark, days_since_login=20.0, trade_freq_trend=-0.5, n_assets=1, portfolio_return_30d=-20.0
    )
    assert only(worst.select(f.rule_churn_prior().alias("p"))).p == 0.95
    calm = wide(spark, yield_adoption=1)
    assert only(calm.select(f.rule_churn_prior().alias("p"))).p == 0.35
    unknown = wide(spark, segment="other")
    assert only(unknown.select(f.rule_churn_prior().alias("p"))).p is None


def test_lag_over_zero_value_is_unknown(spark):
    days = [(1, back(31 - i), float(i)) for i in range(32)]
    table = spark.createDataFrame(days, "user_id BIGINT, snapshot_date DATE, portfolio_value DOUBLE")
    rows = {r.snapshot_date: r.portfolio_return_30d for r in portfolio_return(table).collect()}
    assert rows[back(2)] is None
    assert rows[back(1)] is None
    assert rows[D] == 3000.0


def scores(spark, rows):
    return spark.createDataFrame(
        [
            (u, p, tier, 8, 0, 2000.0, 0, 2, 0.0, datetime(2024, 1, day))
            for u, p, tier, day in rows
        ],
        "user_id BIGINT, churn_probability DOUBLE, risk_tier STRING, days_since_login INT,"
        " trades_30d BIGINT, portfolio_value DOUBLE, yield_adoption INT, n_assets INT,"
        " trade_freq_trend DOUBLE, scored_at TIMESTAMP_NTZ",
    )


def test_targets_use_the_latest_score_once(spark):
    u = users(spark, [(i, 100, 500, 2, 3, None) for i in (1, 2, 3)])
    runs = scores(
        spark,
        [(1, 0.9, "high", 30), (1, 0.2, "medium", 31), (2, 0.9, "high", 30), (2, 0.1, "low", 31),
         (3, 0.5, "high", 29)],
    )
    row = only(campaigns.high_risk_targets(runs, u, D))
    assert (row.user_id, row.churn_probability) == (1, 0.2)
    assert row.recommended_intervention == "yield_product_education"
    assert row.intervention_priority == pytest.approx(0.2)


def test_target_list_is_cut_after_ranking(spark):
    u = users(spark, [(i, 100, 500, 2, 3, None) for i in range(20)])
    runs = scores(spark, [(i, i / 20, "high", 31) for i in range(20)])
    top = campaigns.high_risk_targets(runs, u, D, top=3).collect()
    assert [row.user_id for row in top] == [19, 18, 17]


def test_cohorts_weigh_each_user_once(spark):
    u = users(spark, [(1, 20, 500, 2, 3, None), (2, 20, 500, 2, 3, 10)])
    log = spark.createDataFrame(
        [(1, back(5)), (1, back(4)), (1, back(3)), (2, back(25))],
        "user_id BIGINT, intervention_date DATE",
    )
    row = only(campaigns.cohort_retention(u, log, D))
    assert (row.cohort_size, row.churned_users, row.churn_rate) == (2, 1, 0.5)
    assert row.avg_lifetime_days == 15.0
    # User 2 was contacted before signing up only.
    assert (row.users_with_intervention, row.intervention_retention_rate) == (1, 1.0)


def test_cohort_of_the_cutoff_month_is_left_out(spark):
    u = users(spark, [(1, 365, 500, 2, 3, None), (2, 364, 500, 2, 3, None)])
    log = spark.createDataFrame([], "user_id BIGINT, intervention_date DATE")
    rows = campaigns.cohort_retention(u, log, D).collect()
    assert [row.cohort_month for row in rows] == [date(2023, 2, 1)]
    assert rows[0].intervention_retention_rate is None


def test_calibration_counts_rows_not_users(spark):
    u = users(spark, [(1, 300, 500, 2, 3, 20), (2, 300, 500, 2, 3, None)])
    made = [(1, 0.5, "high"), (1, 0.7, "high"), (2, None, "high")]
    log = spark.createDataFrame(
        [(i, p, t, datetime(2023, 12, 20, 3)) for i, p, t in made],
        "user_id BIGINT, churn_probability DOUBLE, risk_tier STRING, scored_at TIMESTAMP_NTZ",
    )
    row = only(campaigns.model_calibration(log, u, D))
    # Churn on January 11 is 22 days after the prediction.
    assert (row.total_predictions, row.actual_churned) == (3, 2)
    assert row.avg_predicted_prob == pytest.approx(0.6)
    assert row.high_risk_precision == pytest.approx(2 / 3)
    assert row.calibration_error == pytest.approx(0.6 - 2 / 3)


def enrollments(spark, rows):
    return spark.createDataFrame(
        [(u, "t", "control", back(days)) for u, days in rows],
        "user_id BIGINT, test_name STRING, variant STRING, enrolled_date DATE",
    )


def test_experiment_interval(spark):
    u = users(spark, [(1, 100, 1, 2, 3, 20)] + [(i, 100, 1, 2, 3, None) for i in (2, 3, 4)])
    row = only(campaigns.ab_test(enrollments(spark, [(i, 40) for i in (1, 2, 3, 4)]), u, D, "t"))
    assert (row.n_users, row.churned_count, row.churn_rate) == (4, 1, 0.25)
    assert row.std_error == pytest.approx(0.216506, abs=1e-6)
    assert row.ci_lower == pytest.approx(-0.174352, abs=1e-6)
    assert row.ci_upper == pytest.approx(0.674352, abs=1e-6)


def test_experiment_corrections_are_opt_in(spark):
    u = users(spark, [(1, 100, 1, 2, 3, 50), (2, 100, 1, 2, 3, None), (3, 100, 1, 2, 3, None)])
    joined = enrollments(spark, [(1, 40), (2, 40), (3, 10)])
    assert only(campaigns.ab_test(joined, u, D, "t")).churned_count == 1
    row = only(campaigns.ab_test(joined, u, D, "t", min_days=0, require_full_window=True))
    assert (row.n_users, row.churned_count) == (2, 0)
