"""Reports on users at risk: targeting, cohorts, calibration of past scores, experiments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from holdfast.functions import features as f
from holdfast.operators.distinct import key_bitmaps, rolled_up, trailing
from holdfast.operators.intervals import interval_join
from holdfast.operators.resampling import bootstrap_rates, percentile_interval, wilson_interval

c = F.col


def _at_midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _scored_since(scores: DataFrame, since: Column) -> DataFrame:
    """Scores from ``since`` on; prunes the score store's day folders where they exist."""
    if "score_date" in scores.columns:
        scores = scores.filter(c("score_date") >= since)
    return scores.filter(c("scored_at") >= _at_midnight(since))


def latest_score(scores: DataFrame) -> DataFrame:
    """The newest score row of each user.

    A maximum over (time, row) merges map side: unlike a window it never sorts all the runs
    of one user in one task.
    """
    rest = [name for name in scores.columns if name not in ("user_id", "scored_at")]
    newest = F.max(F.struct("scored_at", *rest)).alias("newest")
    return scores.groupBy("user_id").agg(newest).select("user_id", "newest.*")


def high_risk_targets(scores: DataFrame, users: DataFrame, as_of: date, top: int = 10_000) -> DataFrame:
    """The ``top`` users by priority among the high and medium tiers of their latest score."""
    recent = _scored_since(scores, F.date_sub(F.lit(as_of), 1))
    return (
        latest_score(recent)
        .filter(c("risk_tier").isin("high", "medium"))
        .drop("segment", "email")
        .join(users.select("user_id", "email", "segment"), "user_id")
        .select(
            "user_id",
            "email",
            "segment",
            "churn_probability",
            "risk_tier",
            "days_since_login",
            "trades_30d",
            "portfolio_value",
            f.recommended_intervention().alias("recommended_intervention"),
            f.intervention_priority().alias("intervention_priority"),
        )
        .orderBy(F.desc_nulls_last("intervention_priority"), "user_id")
        .limit(top)
    )


def cohort_retention(
    users: DataFrame, interventions: DataFrame, as_of: date, months: int = 12
) -> DataFrame:
    """Churn, lifetime and intervention outcome per sign-up month and segment.

    A user counts as reached if any intervention came on or after the sign-up day, which holds
    exactly if the last one did. So the log shrinks to one date per user before the join, and
    every measure is a plain sum over users: no distinct counts, no rows multiplied.

    A cohort month qualifies by its first day, so the month the cut-off falls in is left out
    unless the cut-off is its first day.
    """
    cutoff = F.add_months(F.lit(as_of), -months)
    last_contact = interventions.groupBy("user_id").agg(F.max("intervention_date").alias("last_contact"))
    created = c("account_created_date")
    reached = F.coalesce(c("last_contact") >= created, F.lit(False))
    lifetime = F.datediff(F.coalesce("churned_date", F.lit(as_of)), created)
    return (
        users.select("user_id", "segment", "account_created_date", "churned_date", "status")
        .withColumn("cohort_month", F.trunc(created, "MM"))
        .filter((created >= cutoff) & (c("cohort_month") >= cutoff))
        .join(last_contact, "user_id", "left")
        .groupBy("cohort_month", "segment")
        .agg(
            F.count("user_id").alias("cohort_size"),
            F.count_if(c("status") == "churned").alias("churned_users"),
            F.avg(lifetime).alias("avg_lifetime_days"),
            F.count_if(reached).alias("users_with_intervention"),
            F.count_if(reached & (c("status") == "active")).alias("retained"),
        )
        .select(
            "cohort_month",
            "segment",
            "cohort_size",
            "churned_users",
            f.ratio(c("churned_users"), c("cohort_size")).alias("churn_rate"),
            "avg_lifetime_days",
            "users_with_intervention",
            f.ratio(c("retained"), c("users_with_intervention")).alias("intervention_retention_rate"),
        )
        .orderBy(F.desc("cohort_month"), "segment")
    )


def model_calibration(
    scores: DataFrame,
    users: DataFrame,
    as_of: date,
    history_days: int = 60,
    horizon_days: int = 30,
    lookback_days: int = 30,
) -> DataFrame:
    """Predicted against observed churn, per scoring day and tier.

    ``actual_churned`` counts churn within ``horizon_days`` of the prediction;
    ``actual_churn_rate`` counts any churn found in the last ``lookback_days``, so the two need
    not agree. Predictions younger than the horizon are left out.

    The scores meet the recent churners first, a side that is broadcast if its measured size
    allows it; the sums per day and tier then shrink map side. So scores are shuffled once at
    most, and adaptive execution splits a user with very many of them.
    """
    day = F.to_date("scored_at")
    matured = F.date_sub(F.lit(as_of), horizon_days)
    predictions = (
        _scored_since(scores, F.date_sub(F.lit(as_of), history_days))
        .filter(day <= matured)
        .select("user_id", day.alias("prediction_date"), "risk_tier", "churn_probability")
    )
    churn = users.filter(c("churned_date") >= F.date_sub(F.lit(as_of), lookback_days)).select(
        "user_id", "churned_date"
    )
    churned = c("churned_date").isNotNull()
    in_time = churned & (F.datediff("churned_date", "prediction_date") <= horizon_days)
    return (
        predictions.join(churn, "user_id", "left")
        .groupBy("prediction_date", "risk_tier")
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            F.count_if(in_time).alias("actual_churned"),
            F.count_if(churned).alias("ever_churned"),
            F.avg("churn_probability").alias("avg_predicted_prob"),
        )
        .withColumn("actual_churn_rate", f.ratio(c("ever_churned"), c("total_predictions")))
        .select(
            "prediction_date",
            "risk_tier",
            "total_predictions",
            "actual_churned",
            "actual_churn_rate",
            "avg_predicted_prob",
            (c("avg_predicted_prob") - c("actual_churn_rate")).alias("calibration_error"),
            F.when(
                c("risk_tier") == "high", f.ratio(c("actual_churned"), c("total_predictions"))
            ).alias("high_risk_precision"),
        )
        .orderBy(F.desc("prediction_date"), "risk_tier")
    )


def ab_test(
    enrollments: DataFrame,
    users: DataFrame,
    as_of: date,
    test_name: str,
    history_days: int = 60,
    horizon_days: int = 30,
    min_days: int | None = None,
    require_full_window: bool = False,
) -> DataFrame:
    """Churn rate per variant with its standard error and 95 % Wald interval.

    By default churn before enrollment counts, and so do users enrolled too recently to have
    been watched for the whole horizon. ``min_days=0`` and ``require_full_window=True`` give
    the corrected reading.
    """
    enrolled = enrollments.filter(
        (c("test_name") == test_name)
        & (c("enrolled_date") >= F.date_sub(F.lit(as_of), history_days))
    )
    if require_full_window:
        enrolled = enrolled.filter(c("enrolled_date") <= F.date_sub(F.lit(as_of), horizon_days))
    enrolled = enrolled.select("user_id", "variant", "enrolled_date")
    elapsed = F.datediff("churned_date", "enrolled_date")
    within = elapsed <= horizon_days
    if min_days is not None:
        within = within & (elapsed >= min_days)
    rate = c("churn_rate")
    margin = F.lit(1.96) * c("std_error")
    return (
        enrolled.join(users.select("user_id", "churned_date"), "user_id")
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.count_if(within).alias("churned_count"),
        )
        .withColumn("churn_rate", f.ratio(c("churned_count"), c("n_users")))
        .withColumn("std_error", F.sqrt(rate * (F.lit(1.0) - rate) / c("n_users")))
        .withColumns({"ci_lower": rate - margin, "ci_upper": rate + margin})
    )


# Names of the sets of users that reach reports count.
REACH_SETS = ("users", "users_with_intervention", "retained")


def contact_bitmaps(users: DataFrame, interventions: DataFrame) -> DataFrame:
    """Sets of users per cohort month, segment and contact day, as bitmaps.

    The log may name a user any number of times; equal (user, day) rows are one before the join.
    A user without a contact is in the sets of a day that is NULL.
    """
    contacts = interventions.select("user_id", "intervention_date").distinct()
    created = c("account_created_date")
    reached = c("intervention_date") >= created
    rows = (
        users.select("user_id", "segment", "account_created_date", "status")
        .join(contacts, "user_id", "left")
        .withColumn("cohort_month", F.trunc(created, "MM"))
    )
    sets = {"users": F.lit(True), "users_with_intervention": reached, "retained": reached & (c("status") == "active")}
    return key_bitmaps(rows, "user_id", ["cohort_month", "segment", "intervention_date"], sets)


def contact_reach(bitmaps: DataFrame) -> DataFrame:
    """Distinct users in each set per cohort and segment, per cohort, per contact day, and over all,
    all from the bitmaps of the finest groups."""
    levels = {
        "cohort_segment": ["cohort_month", "segment"],
        "cohort": ["cohort_month"],
        "day": ["intervention_date"],
        "all": [],
    }
    return rolled_up(bitmaps, levels, REACH_SETS)


def contacted_users(interventions: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Distinct users contacted on each day, and in the ``days`` days up to it."""
    bitmaps = key_bitmaps(interventions, "user_id", ["intervention_date"], {"n": F.lit(True)})
    wide = trailing(bitmaps, "intervention_date", days, ["n"], F.lit(as_of)).withColumnRenamed("n", "users_trailing")
    daily = trailing(bitmaps, "intervention_date", 1, ["n"], F.lit(as_of)).withColumnRenamed("n", "users_day")
    return wide.join(daily, "intervention_date", "left").select(
        "intervention_date", F.coalesce("users_day", F.lit(0).cast("bigint")).alias("users_day"), "users_trailing"
    )


def signup_contacts(users: DataFrame, interventions: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Contacts in the first ``days`` days of each cohort's users, and the wait for the first one.

    Unlike the last contact, which tells whether there was one, the interval join counts them.
    """
    contacts = (
        interventions.filter(c("intervention_date") <= F.lit(as_of))
        .groupBy("user_id", "intervention_date")
        .agg(F.count(F.lit(1)).alias("contacts"))
    )
    created = c("account_created_date")
    watched = users.select("user_id", created, F.date_add(created, days).alias("until"))
    met = (
        interval_join(watched, contacts, "account_created_date", "until", "intervention_date", days, ["user_id"])
        .groupBy("user_id")
        .agg(F.sum("contacts").alias("contacts"), F.min(F.datediff("intervention_date", created)).alias("wait"))
    )
    return (
        users.select("user_id", "segment", F.trunc(created, "MM").alias("cohort_month"))
        .join(met, "user_id", "left")
        .groupBy("cohort_month", "segment")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.count("contacts").alias("contacted_users"),
            F.coalesce(F.sum("contacts"), F.lit(0)).alias("n_contacts"),
            F.avg("wait").alias("avg_days_to_contact"),
        )
    )


def market_after_signup(users: DataFrame, returns: DataFrame, days: int = 30) -> DataFrame:
    """Mean daily market return over the first ``days`` days of a cohort's users.

    Users meet market days by time alone: no key but the band of days. Users of a day and segment
    are one row before the join.
    """
    created = c("account_created_date")
    starts = users.groupBy("segment", created).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("until", F.date_add(created, days - 1))
    pairs = interval_join(starts, returns, "account_created_date", "until", "date", days)
    return (
        pairs.groupBy(F.trunc(created, "MM").alias("cohort_month"), "segment")
        .agg(
            F.sum("n").alias("n_user_days"),
            f.ratio(F.sum(c("n") * c("daily_return")), F.sum("n")).alias("avg_return"),
        )
    )


def ab_bootstrap(
    enrollments: DataFrame,
    users: DataFrame,
    as_of: date,
    test_name: str,
    control: str = "control",
    history_days: int = 60,
    horizon_days: int = 30,
    replicates: int = 200,
) -> DataFrame:
    """Churn rate of each variant and its difference to ``control``, with 95 % intervals from
    Poisson bootstrap replicates, and the variant's Wilson interval.

    Users enrolled too recently to have been watched for the whole horizon don't count, nor does
    churn before enrollment. A user is drawn as often in every variant of a replicate, which the
    variants' difference needs if someone is in two.
    """
    enrolled = enrollments.filter(
        (c("test_name") == test_name)
        & c("enrolled_date").between(
            F.date_sub(F.lit(as_of), history_days), F.date_sub(F.lit(as_of), horizon_days)
        )
    ).select("user_id", "variant", "enrolled_date")
    rows = enrolled.join(users.select("user_id", "churned_date"), "user_id")
    churned = F.datediff("churned_date", "enrolled_date").between(0, horizon_days)
    observed = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if(churned).alias("churned_count")
    )
    # One row per variant and replicate.
    drawn = bootstrap_rates(rows, "user_id", ["variant"], churned, replicates)
    base = F.max(F.when(c("variant") == control, c("rate"))).over(W.partitionBy("replicate"))
    interval = (
        drawn.withColumn("base", base)
        .groupBy("variant")
        .agg(percentile_interval(c("rate")).alias("own"), percentile_interval(c("rate") - c("base")).alias("lift"))
    )
    of_control = F.max(F.when(c("variant") == control, c("churn_rate")))
    # One row: the rate of the control.
    reference = observed.withColumn("churn_rate", f.ratio(c("churned_count"), c("n_users"))).agg(of_control.alias("control_rate"))
    low, high = wilson_interval(c("churned_count"), c("n_users"))
    return (
        observed.withColumn("churn_rate", f.ratio(c("churned_count"), c("n_users")))
        .join(interval, "variant")
        .withColumn("control_rate", reference.scalar())
        .select(
            "variant",
            "n_users",
            "churned_count",
            "churn_rate",
            c("own")[0].alias("ci_lower"),
            c("own")[1].alias("ci_upper"),
            low.alias("wilson_lower"),
            high.alias("wilson_upper"),
            (c("churn_rate") - c("control_rate")).alias("lift"),
            c("lift")[0].alias("lift_lower"),
            c("lift")[1].alias("lift_upper"),
        )
    )
