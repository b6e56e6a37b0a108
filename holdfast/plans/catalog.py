"""Every named report, bound to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.bindings import USER_FEATURES_SCHEMA, Tables
from holdfast.config import (
    AGE_BUCKET,
    CATEGORICAL,
    HEATMAP_FEATURES,
    MODEL_FEATURES,
    RISK_SEGMENT_LABELS,
)
from holdfast.functions import features as f
from holdfast.functions.bins import right_closed
from holdfast.operators import market, metrics, profile
from holdfast.operators.activity import activity_features, activity_log, portfolio_return
from holdfast.operators.ordering import hashed_sample
from holdfast.operators.sampling import class_weights, stratified_split
from holdfast.plans import campaigns, daily, training
from holdfast.plans.feature_table import user_features
from holdfast.plans.scoring import interaction_features, model_scores, scoring_report, user_segments
from holdfast.session import RUN_DIR, fresh_path
from holdfast.sources import stores, typed_csv

c = F.col
Query = Callable[[SparkSession, str], DataFrame]

TEST_NAME = "yield_education_intervention"
RATE_KEYS = ("segment", "yield_adoption", "advanced_trading", "n_assets", "age_bucket", "risk_segment")
# Numeric columns of the feature table, and those where 0 stands for an unknown value.
COMOMENT_FEATURES = (
    "user_id", "account_age_days", "portfolio_value", "n_assets", "trades_30d", "avg_trade_size",
    "days_since_login", "trade_freq_trend", "yield_adoption", "advanced_trading", "volatility_sensitivity",
    "portfolio_return_30d", "churned", "trading_intensity", "portfolio_concentration", "engagement_score",
    "high_risk_profile",
)
SPARSE_FEATURES = ("avg_trade_size", "trade_freq_trend")
# Days that the daily runs are followed for.
RING_DAYS, WINDOW_DAYS = 5, 20
BUCKETS = 8
# Share of a column's cells that may miss its type.
TOLERANCE = 0.05
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        _QUERIES[name] = run
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Scoring and campaigns


@query("churn_daily_scoring")
def _(t: Tables) -> DataFrame:
    return scoring_report(t.scores_on(t.as_of))


@query("churn_scoring_backfill")
def _(t: Tables) -> DataFrame:
    """The scores as they would have been 20 days before."""
    return scoring_report(t.scores_on(t.as_of - timedelta(days=20)))


@query("churn_daily_scoring_zero_trend")
def _(t: Tables) -> DataFrame:
    return scoring_report(t.scores_on(t.as_of, null_trend=0.0))


@query("activity_features")
def _(t: Tables) -> DataFrame:
    log = activity_log(t.trades(), t.yield_products(), t.advanced_trading_users())
    return activity_features(t.users(), log, t.as_of)


@query("portfolio_return_lag30")
def _(t: Tables) -> DataFrame:
    return portfolio_return(t.snapshots())


@query("high_risk_targeting")
def _(t: Tables) -> DataFrame:
    return campaigns.high_risk_targets(t.recent_scores(), t.users(), t.as_of)


@query("cohort_retention")
def _(t: Tables) -> DataFrame:
    return campaigns.cohort_retention(t.users(), t.interventions(), t.as_of)


@query("model_calibration")
def _(t: Tables) -> DataFrame:
    return campaigns.model_calibration(t.logged_scores(), t.users(), t.as_of)


@query("ab_test_ci")
def _(t: Tables) -> DataFrame:
    return campaigns.ab_test(t.enrollments(), t.users(), t.as_of, TEST_NAME)


@query("ab_test_ci_observed")
def _(t: Tables) -> DataFrame:
    return campaigns.ab_test(
        t.enrollments(), t.users(), t.as_of, TEST_NAME, min_days=0, require_full_window=True
    )


@query("ab_test_bootstrap")
def _(t: Tables) -> DataFrame:
    return campaigns.ab_bootstrap(t.enrollments(), t.users(), t.as_of, TEST_NAME)


@query("contact_reach")
def _(t: Tables) -> DataFrame:
    return campaigns.contact_reach(campaigns.contact_bitmaps(t.users(), t.interventions()))


@query("contacted_users_trailing")
def _(t: Tables) -> DataFrame:
    return campaigns.contacted_users(t.interventions(), t.as_of)


@query("signup_contacts")
def _(t: Tables) -> DataFrame:
    return campaigns.signup_contacts(t.users(), t.interventions(), t.as_of)


@query("market_after_signup")
def _(t: Tables) -> DataFrame:
    return campaigns.market_after_signup(t.users(), t.market_returns())


# Features


@query("derived_features")
def _(t: Tables) -> DataFrame:
    return t.user_features().select(
        "user_id",
        "trading_intensity",
        "portfolio_concentration",
        "engagement_score",
        "high_risk_profile",
        "account_stage",
    )


@query("operational_features")
def _(t: Tables) -> DataFrame:
    return user_features(t.users(), t.activity_log(), t.snapshots(), t.as_of)


@query("interaction_features")
def _(t: Tables) -> DataFrame:
    return interaction_features(t.user_features()).select(
        "user_id", "value_engagement_ratio", "inactivity_decline_risk", "concentration_loss"
    )


@query("user_segments")
def _(t: Tables) -> DataFrame:
    return user_segments(t.user_features()).select("user_id", "risk_segment", "value_segment")


@query("rule_churn_prior")
def _(t: Tables) -> DataFrame:
    return t.user_features().select("user_id", f.rule_churn_prior().alias("churn_prior"))


# Profiles


@query("churn_by_segment")
def _(t: Tables) -> DataFrame:
    return profile.rate_by(t.user_features(), "segment").orderBy("churn_rate", "segment")


@query("churn_by_yield")
def _(t: Tables) -> DataFrame:
    return profile.rate_by(t.user_features(), "yield_adoption").orderBy("yield_adoption")


@query("churn_by_advanced")
def _(t: Tables) -> DataFrame:
    return profile.rate_by(t.user_features(), "advanced_trading").orderBy("advanced_trading")


@query("churn_by_assets")
def _(t: Tables) -> DataFrame:
    return profile.rate_by(t.user_features(), "n_assets").orderBy("n_assets")


@query("churn_by_age_bucket")
def _(t: Tables) -> DataFrame:
    bucketed = t.user_features().withColumn("age_bucket", right_closed("account_age_days", AGE_BUCKET))
    return profile.complete(profile.rate_by(bucketed, "age_bucket"), "age_bucket", AGE_BUCKET.labels)


@query("churn_by_risk")
def _(t: Tables) -> DataFrame:
    rates = profile.rate_by(user_segments(t.user_features()), "risk_segment")
    return profile.complete(rates, "risk_segment", RISK_SEGMENT_LABELS[::-1])


@query("churn_by_all")
def _(t: Tables) -> DataFrame:
    """All the rates above from one scan."""
    bucketed = right_closed("account_age_days", AGE_BUCKET)
    rows = user_segments(t.user_features()).withColumn("age_bucket", bucketed)
    return profile.rates_by(rows, RATE_KEYS)


@query("profile_shape")
def _(t: Tables) -> DataFrame:
    return profile.shape(t.user_features())


@query("profile_value_counts")
def _(t: Tables) -> DataFrame:
    return profile.value_counts(t.user_features(), "segment")


@query("profile_describe")
def _(t: Tables) -> DataFrame:
    return profile.describe(t.user_features())


@query("profile_null_counts")
def _(t: Tables) -> DataFrame:
    return profile.null_counts(t.activity(status=None))


@query("corr_with_target")
def _(t: Tables) -> DataFrame:
    return profile.correlation_with(t.user_features(), "churned")


@query("corr_matrix")
def _(t: Tables) -> DataFrame:
    return profile.correlation_matrix(t.user_features(), HEATMAP_FEATURES)


@query("comoment_matrix")
def _(t: Tables) -> DataFrame:
    """All numeric features, unknown values as they are before filling."""
    unknown = {name: F.when(c(name) != 0, c(name)).alias(name) for name in SPARSE_FEATURES}
    rows = t.user_features()
    return profile.comoment_matrix(rows.select(*[unknown.get(n, c(n)) for n in COMOMENT_FEATURES]), COMOMENT_FEATURES)


@query("histogram_by_class")
def _(t: Tables) -> DataFrame:
    return profile.histogram(t.user_features(), "days_since_login", "churned")


@query("boxplot_by_class")
def _(t: Tables) -> DataFrame:
    return profile.boxplot(t.user_features(), "days_since_login", "churned")


@query("head_preview")
def _(t: Tables) -> DataFrame:
    return t.user_features().orderBy("user_id").limit(10)


# Preparation


@query("label_encode")
def _(t: Tables) -> DataFrame:
    features = t.user_features().select("user_id", *CATEGORICAL)
    codes = [c(f"{name}_encoded").cast("int").alias(f"{name}_encoded") for name in CATEGORICAL]
    return training.fit_encoder(features).transform(features).select("user_id", *CATEGORICAL, *codes)


@query("stratified_split")
def _(t: Tables) -> DataFrame:
    labelled = t.user_features().select("user_id", "churned")
    return stratified_split(labelled, "user_id", "churned")


@query("standard_scale")
def _(t: Tables) -> DataFrame:
    prepared = training.prepare(t.user_features())
    return prepared.scaler.transform(prepared.rows).select(
        "user_id", "split", *[f"{name}_scaled" for name in MODEL_FEATURES]
    )


@query("class_weights")
def _(t: Tables) -> DataFrame:
    labelled = t.user_features().select("user_id", "churned")
    train = stratified_split(labelled, "user_id", "churned").filter(c("split") == "train")
    return class_weights(train, "churned")


@query("sample_rows")
def _(t: Tables) -> DataFrame:
    return hashed_sample(t.user_features().select("user_id", "segment", "churned"), "user_id", 1000)


# Metrics of given scores


@query("confusion_matrix")
def _(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(t.scored())


@query("classification_report")
def _(t: Tables) -> DataFrame:
    return metrics.classification_report(t.scored())


@query("roc_curve")
def _(t: Tables) -> DataFrame:
    return metrics.roc_curve(t.scored())


@query("pr_curve")
def _(t: Tables) -> DataFrame:
    return metrics.pr_curve(t.scored())


@query("auc_roc")
def _(t: Tables) -> DataFrame:
    return metrics.auc_roc(t.scored())


@query("average_precision")
def _(t: Tables) -> DataFrame:
    return metrics.average_precision(t.scored())


@query("precision_at_top_decile")
def _(t: Tables) -> DataFrame:
    return metrics.precision_at_top(t.scored())


# The published logit and the rule prior, compared like trained models


@query("scorer_comparison")
def _(t: Tables) -> DataFrame:
    return metrics.summary(t.scorers())


@query("scorer_best")
def _(t: Tables) -> DataFrame:
    return metrics.summary(t.scorers()).orderBy(F.desc("auc_roc"), "model").limit(1).select("model", "auc_roc")


@query("scorer_roc_curve")
def _(t: Tables) -> DataFrame:
    return metrics.roc_curve(t.scorers(), ["model"])


@query("scorer_pr_curve")
def _(t: Tables) -> DataFrame:
    return metrics.pr_curve(t.scorers(), ["model"])


@query("scorer_confusion")
def _(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(t.scorers(), ["model"])


# Market series


@query("rolling_volatility")
def _(t: Tables) -> DataFrame:
    return market.rolling_volatility(t.market_returns()).drop("asset")


@query("price_index")
def _(t: Tables) -> DataFrame:
    return market.price_index(t.market_returns()).drop("asset")


@query("date_spine")
def _(t: Tables) -> DataFrame:
    days = t.raw("events").select(F.to_date("ts").alias("day"))
    return market.date_spine(days, "day", t.as_of, 90)


# Scalars


@query("format_user_id")
def _(t: Tables) -> DataFrame:
    return t.users().select("user_id", F.format_string("user_%06d", "user_id").alias("user_label"))


@query("round_and_cast")
def _(t: Tables) -> DataFrame:
    balance = c("portfolio_value")
    return t.users().select(
        "user_id",
        F.bround(balance / F.lit(10.0), 1).alias("rounded"),
        (balance / F.lit(10.0)).cast("int").alias("truncated"),
    )


# Stores


@query("csv_roundtrip")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "user_features_csv")
    stores.write_csv(t.user_features(), path)
    return stores.read_csv(t.spark, path, USER_FEATURES_SCHEMA)


@query("score_store_roundtrip")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "scores")
    stores.write_scores(t.recent_scores(), path)
    # Rerun of one day: it must replace that day and leave the other alone.
    stores.write_scores(t.scores_on(t.as_of), path)
    stored = stores.read_scores(t.spark, path)
    return (
        stored.groupBy("score_date", "risk_tier")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.count("churn_probability").alias("n_scored"),
            F.sum("churn_probability").alias("expected_churn"),
        )
        .orderBy("score_date", "risk_tier")
    )


@query("store_targeting")
def _(t: Tables) -> DataFrame:
    """Targets from the stored runs: folders before the last two days are never opened."""
    path = fresh_path(t.spark, "scores")
    stores.write_scores(t.recent_scores(), path)
    scores = stores.read_scores(t.spark, path, since=t.as_of - timedelta(days=1))
    return campaigns.high_risk_targets(scores, t.users(), t.as_of)


@query("store_calibration")
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "scores")
    stores.write_scores(t.logged_scores(), path)
    return campaigns.model_calibration(stores.read_scores(t.spark, path), t.users(), t.as_of)


def _last_days(t: Tables, n: int) -> list[date]:
    return [t.as_of - timedelta(days=back) for back in range(n - 1, -1, -1)]


@query("portfolio_return_daily")
def _(t: Tables) -> DataFrame:
    """The last days' returns, each from that day's snapshots and the state of the day before."""
    days, stored = _last_days(t, RING_DAYS), fresh_path(t.spark, "snapshots")
    stores.write_days(t.snapshots(), stored, "snapshot_date")
    schema = "user_id BIGINT, portfolio_value DOUBLE, day DATE"
    snapshots = t.spark.read.schema(schema).parquet(stored).withColumnRenamed("day", "snapshot_date")
    state = fresh_path(t.spark, "rings")
    daily.first_ring(snapshots, days[0] - timedelta(days=1), state)
    for day in days:
        daily.advance_ring(t.spark, snapshots, day, state)
    return daily.returns_of(t.spark, state, days)


@query("activity_windows_daily")
def _(t: Tables) -> DataFrame:
    """The trade windows of the last days, slid on from day to day."""
    days, deltas, state = _last_days(t, WINDOW_DAYS), fresh_path(t.spark, "deltas"), fresh_path(t.spark, "windows")
    stores.write_days(daily.daily_trades(t.trades()), deltas)
    changes = t.spark.read.schema(daily.DELTA_SCHEMA).parquet(deltas)
    daily.first_windows(changes, days[0] - timedelta(days=1), state)
    for day in days:
        daily.advance_windows(t.spark, deltas, day, state)
    return daily.windows_of(t.spark, state, days)


def _bucketed(t: Tables, rows: DataFrame, name: str, day: str | None = None) -> DataFrame:
    path = fresh_path(t.spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    return stores.write_bucketed(rows, table, path, "user_id", BUCKETS, day)


@query("bucketed_targeting")
def _(t: Tables) -> DataFrame:
    """Targets from scores and users dealt by user: they meet without a shuffle."""
    scores = t.recent_scores().withColumn("score_date", F.to_date("scored_at"))
    users = t.users().select("user_id", "email", "segment")
    return campaigns.high_risk_targets(
        _bucketed(t, scores, "scores", "score_date"), _bucketed(t, users, "users"), t.as_of
    )


@query("bucketed_calibration")
def _(t: Tables) -> DataFrame:
    scores = t.logged_scores().withColumn("score_date", F.to_date("scored_at"))
    users = t.users().select("user_id", "churned_date")
    return campaigns.model_calibration(
        _bucketed(t, scores, "scores", "score_date"), _bucketed(t, users, "users"), t.as_of
    )


def _untyped_csv(t: Tables) -> str:
    """The users as CSV, with cells that don't fit their column in some rows."""
    path = fresh_path(t.spark, "users_csv")
    key = c("user_id")
    rows = t.users().select(
        key,
        "segment",
        F.when(key % 50 == 1, "n/a").otherwise(c("portfolio_value").cast("string")).alias("portfolio_value"),
        F.when(key % 60 == 2, "many").when(key % 3 > 0, c("n_assets").cast("string")).alias("n_assets"),
        F.when(key % 70 == 3, "2023-13-45").otherwise(c("account_created_date").cast("string")).alias("created"),
        (c("status") == "churned").alias("churned"),
        (key * 3_000_000_000).alias("big"),
    )
    stores.write_csv(rows, path)
    return path


@query("csv_inferred_types")
def _(t: Tables) -> DataFrame:
    return typed_csv.column_types(typed_csv.read_cells(t.spark, _untyped_csv(t)), TOLERANCE)


@query("csv_quarantine")
def _(t: Tables) -> DataFrame:
    table = typed_csv.read_typed_csv(t.spark, _untyped_csv(t), TOLERANCE)
    return typed_csv.quarantine(table, ["user_id"])


@query("csv_typed")
def _(t: Tables) -> DataFrame:
    return typed_csv.read_typed_csv(t.spark, _untyped_csv(t), TOLERANCE).drop(typed_csv.BAD)


# Models

_TRAININGS: dict[tuple, training.Training] = {}


def trained(t: Tables) -> training.Training:
    """Prepared data and models of a folder's present files, shared by the reports of one
    application and run. Files that change are other data."""
    files = (t.version(name) for name in ("customer", "events"))
    key = (t.spark.sparkContext.applicationId, t.spark.conf.get(RUN_DIR, None), t.folder, *files)
    if key not in _TRAININGS:
        _TRAININGS[key] = training.Training(training.prepare(t.learnable_user_features()))
    return _TRAININGS[key]


def forget_trainings() -> None:
    """Train anew on the next model report."""
    _TRAININGS.clear()


@query("ml_logistic_regression")
def _(t: Tables) -> DataFrame:
    return trained(t).scored("logistic_regression", "val")


@query("ml_random_forest")
def _(t: Tables) -> DataFrame:
    return trained(t).scored("random_forest", "val")


@query("ml_gbt")
def _(t: Tables) -> DataFrame:
    return trained(t).scored("gradient_boosting", "val")


@query("model_score_store")
def _(t: Tables) -> DataFrame:
    """Scores of all users by the trained linear model, stored and read again."""
    models = trained(t)
    path = fresh_path(t.spark, "scores")
    full = models.full_model("logistic_regression")
    stores.write_scores(model_scores(full, t.learnable_user_features(), t.as_of), path)
    p = c("churn_probability")
    return (
        stores.read_scores(t.spark, path)
        .groupBy("score_date")
        .agg(F.count(F.lit(1)).alias("n_users"), F.count_if(p.between(0.0, 1.0)).alias("n_scored"))
    )


@query("model_roc_curves")
def _(t: Tables) -> DataFrame:
    """Every ROC point of every trained model on the held-out rows."""
    return metrics.roc_curve(trained(t).all_scored("test"), ["model"])


@query("model_confusion")
def _(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(trained(t).all_scored("test"), ["model"])


@query("model_comparison")
def _(t: Tables) -> DataFrame:
    return trained(t).comparison()


@query("best_model")
def _(t: Tables) -> DataFrame:
    return trained(t).best()


@query("test_evaluation")
def _(t: Tables) -> DataFrame:
    return trained(t).test_evaluation()


@query("feature_importance")
def _(t: Tables) -> DataFrame:
    models = trained(t)
    name = models.best_name()
    return training.feature_importance(t.spark, models.model(name), models.data.features, name)


@query("linear_attribution")
def _(t: Tables) -> DataFrame:
    models = trained(t)
    model = models.model("logistic_regression")
    return training.linear_attribution(model, models.data.part("test"), models.data.features)


@query("permutation_importance")
def _(t: Tables) -> DataFrame:
    models = trained(t)
    name = models.best_name()
    return training.permutation_importance(
        models.model(name), models.data.part("test"), models.data.features
    )


@query("model_save_load")
def _(t: Tables) -> DataFrame:
    """Save the best model with its preparation, load it, and score the wide table."""
    models = trained(t)
    name = models.best_name()
    path = fresh_path(t.spark, f"{name}_best")
    loaded = stores.load_model(stores.save_model(models.full_model(name), path))
    encoded = [f"{name}_encoded" for name in CATEGORICAL]
    wide = models.data.rows.drop(*encoded).withColumn("label", c("churned"))
    return training.score(loaded, wide, name, "user_id")


@query("model_checks")
def _(t: Tables) -> DataFrame:
    """What must hold of the trained models, counted."""
    return training.model_checks(trained(t), fresh_path(t.spark, "checked"))
