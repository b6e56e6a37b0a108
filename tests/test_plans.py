"""Physical plans keep the properties they need at scale."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from holdfast.bindings import Tables
from holdfast.operators import metrics, profile
from holdfast.operators.radix import radix_quantiles
from holdfast.operators.sampling import stratified_split
from holdfast.plans import campaigns, catalog
from holdfast.sources import stores

TRAINED = {
    "ml_logistic_regression", "ml_random_forest", "ml_gbt", "model_comparison", "best_model",
    "test_evaluation", "feature_importance", "linear_attribution", "permutation_importance",
    "model_save_load", "model_checks",
}


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for sides too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - TRAINED))
def test_no_query_pairs_all_rows(spark, small_dir, no_broadcast, name):
    text = plan(contract.queries()[name](spark, small_dir))
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text


def test_scoring_shuffles_each_table_once(spark, small_dir, no_broadcast):
    text = plan(contract.queries()["churn_daily_scoring"](spark, small_dir))
    assert text.count("FileScan") == 2
    assert text.count("Exchange hashpartitioning(user_id") == 2
    assert text.count("Exchange rangepartitioning") == 1
    assert text.count("Exchange ") == 3
    assert "EqualTo(event_type,purchase)" in text


def test_unread_logins_are_not_joined(spark, small_dir):
    text = plan(profile.rate_by(Tables(spark, small_dir).user_features(), "segment"))
    assert "Join" not in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text


def executed_scans(df):
    """File scans the finished query really ran: reused stages and initial plans do not count."""
    df.collect()
    scans, skip_from = 0, None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if skip_from is not None and depth >= skip_from:
            continue
        skip_from = None
        if "== Initial Plan ==" in line:
            skip_from = depth
        elif "FileScan" in line:
            scans += 1
    return scans


def test_ordered_measures_scan_their_rows_once(spark, small_dir):
    t = Tables(spark, small_dir)
    scored = t.scored().withColumn("model", F.lit("m"))
    assert executed_scans(metrics.auc_roc(scored)) == 1
    assert executed_scans(metrics.pr_curve(scored)) == 1
    assert executed_scans(metrics.summary(scored)) == 1


def jobs_of(spark, build):
    """Jobs that run while a query is built."""
    spark.sparkContext.setJobGroup("building", "")
    try:
        query = build()
        return query, len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    finally:
        spark.sparkContext.setJobGroup("other", "")


@pytest.mark.parametrize(
    "name",
    ["auc_roc", "average_precision", "precision_at_top_decile", "roc_curve", "pr_curve", "scorer_comparison",
     "profile_describe", "boxplot_by_class"],
)
def test_nothing_runs_while_a_measure_is_built(spark, small_dir, name):
    query, jobs = jobs_of(spark, lambda: contract.queries()[name](spark, small_dir))
    assert jobs == 0 and query.count() > 0


@pytest.mark.parametrize("partitions", ["4", "64"])
def test_quantiles_take_four_scans_and_shuffle_counts_only(spark, small_dir, no_broadcast, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        balances = Tables(spark, small_dir).raw("customer").select("c_acctbal", (F.col("c_custkey") % 2).alias("g"))
        quartiles = radix_quantiles(balances, "c_acctbal", {"q": 0.25, "m": 0.5, "p": 0.75}, ["g"])
        assert executed_scans(quartiles) == 4
        text = plan(quartiles).split("== Initial Plan ==")[0]
        # Only partial counts are sent.
        assert "Exchange hashpartitioning(c_acctbal" not in text and "rangepartitioning" not in text
        assert executed_scans(profile.boxplot(balances, "c_acctbal", "g")) == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_rates_come_from_one_scan(spark, small_dir):
    rows = Tables(spark, small_dir).raw("customer").select("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 2).alias("y"))
    assert executed_scans(profile.rates_by(rows, ["c_mktsegment", "c_nationkey"], "y")) == 1


@pytest.mark.parametrize("name", ["bucketed_targeting", "bucketed_calibration"])
def test_bucketed_tables_meet_without_a_shuffle(spark, small_dir, no_broadcast, name):
    text = plan(contract.queries()[name](spark, small_dir))
    assert "Bucketed: true" in text
    assert "Exchange hashpartitioning(user_id" not in text


def test_interval_joins_are_equality_joins(spark, small_dir, no_broadcast):
    for name in ("signup_contacts", "market_after_signup"):
        text = plan(contract.queries()[name](spark, small_dir))
        assert "SortMergeJoin" in text and "__band" in text


def test_reach_reads_its_rows_once(spark, small_dir):
    t = Tables(spark, small_dir)
    users = t.users().drop("last_login_date")
    # Customers and events once each, for four levels.
    assert executed_scans(campaigns.contact_reach(campaigns.contact_bitmaps(users, t.interventions()))) == 2


def test_a_days_step_reads_one_folder(spark, small_dir, tmp_path):
    day = date(2024, 1, 10)
    rows = spark.range(20).selectExpr("id AS user_id", "date_add(date'2024-01-01', cast(id % 10 AS int)) AS day", "1.0D AS portfolio_value")
    stores.write_days(rows, str(tmp_path))
    text = plan(stores.read_days(spark, str(tmp_path), "user_id BIGINT, portfolio_value DOUBLE, day DATE", [day]))
    assert "PartitionFilters: [isnotnull(day" in text


def test_the_plan_of_a_wide_matrix_stays_flat(spark):
    sizes = []
    for width in (4, 17):
        rows = spark.range(5).select(*[(F.col("id") + i).cast("double").alias(f"x{i}") for i in range(width)])
        text = plan(profile.comoment_matrix(rows, rows.columns))
        sizes.append(text.count("corr") + text.count("covar_pop"))
    assert sizes[0] == sizes[1]


def test_split_has_no_single_task_window(spark, small_dir, no_broadcast):
    users = Tables(spark, small_dir).user_features().select("user_id", "churned")
    assert "SinglePartition" not in plan(stratified_split(users, "user_id", "churned"))
