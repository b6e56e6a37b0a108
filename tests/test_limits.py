"""What must not happen: look-ahead, lost rows, overflow, silent fills, plans that explode."""

import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from holdfast.bindings import Tables
from holdfast.operators import metrics
from holdfast.operators.activity import activity_features, activity_log
from holdfast.operators.ordering import hashed_rank, running_totals
from holdfast.operators.sampling import stratified_split
from holdfast.plans import training
from holdfast.plans.feature_table import user_features
from holdfast.sources import stores

AS_OF = date(2024, 1, 10)
USERS = (
    "user_id long, segment string, account_created_date date, portfolio_value double, n_assets int,"
    " last_login_date date, status string"
)


def later(days):
    return AS_OF + timedelta(days=days)


@pytest.fixture()
def tables(spark):
    users = spark.createDataFrame(
        [
            (1, "a", later(-100), 10.0, 1, later(-3), "active"),
            (2, "a", later(-50), 10.0, 1, later(5), "churned"),
            (3, "a", later(1), 10.0, 1, later(2), "active"),
            (4, "a", later(0), 10.0, 1, None, "active"),
        ],
        USERS,
    )
    trades = spark.createDataFrame(
        [(1, 5.0, later(-1)), (1, 7.0, later(10)), (2, 3.0, later(1)), (2, 9.0, later(-31))],
        "user_id long, trade_amount double, trade_date date",
    )
    nobody = users.select("user_id").limit(0)
    return users, activity_log(trades, nobody, nobody)


def test_nothing_after_the_day_counts(tables):
    rows = {r.user_id: r for r in activity_features(*tables, AS_OF, status=None).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].trades_30d, rows[1].avg_trade_size, rows[1].days_since_login) == (1, 5.0, 3)
    assert (rows[2].trades_30d, rows[2].days_since_login) == (0, None)


@pytest.mark.parametrize("back", [0, 1, 5, 20, 29])
def test_backfills_see_no_later_login(spark, small_dir, back):
    t = Tables(spark, small_dir)
    rows = t.activity(as_of=t.as_of - timedelta(days=back))
    assert rows.filter("days_since_login < 0 OR account_age_days < 0").count() == 0
    assert rows.count() > 0


def test_rows_without_a_label_stay(spark):
    rows = spark.range(100).selectExpr("id AS user_id", "CASE WHEN id % 10 < 9 THEN id % 2 END AS churned")
    split = stratified_split(rows, "user_id", "churned")
    assert split.count() == 100 and split.filter("churned IS NULL").count() == 10
    ranks = hashed_rank(rows, "user_id", by=["churned"]).filter("churned IS NULL").select("rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 11))


def test_areas_of_billions(spark):
    rows = [(0.9, 4_000_000_000, 1_000_000_000), (0.1, 1_000_000_000, 4_000_000_000)]
    steps = spark.createDataFrame(rows, "score double, pos long, neg long")
    counted = running_totals(steps, "score", ["pos", "neg"], descending=True)
    area, precision = counted.agg(metrics._area(), metrics._average_precision()).first()
    assert area == pytest.approx(0.8 * 0.8 + 0.5 * (0.8 * 0.2 * 2))
    assert precision == pytest.approx(0.8 * 0.8 + 0.2 * 0.5)


def test_many_partitions_plan_quickly(spark, small_dir):
    scored = Tables(spark, small_dir).scored()
    want = metrics.auc_roc(scored).first()[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8192")
    try:
        start = time.perf_counter()
        curve = metrics.auc_roc(scored)
        text = curve._jdf.queryExecution().optimizedPlan().toString()
        assert time.perf_counter() - start < 30
        assert len(text) < 1_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert metrics.auc_roc(scored).first()[0] == want


def test_buckets_decide_nothing(spark):
    rows = spark.range(500).selectExpr("id % 97 / 7.0 AS v").groupBy("v").agg(F.count("*").alias("n"))
    want = None
    for partitions in ("1", "8", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted(tuple(r) for r in running_totals(rows, "v", ["n"]).collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    empty = running_totals(rows.limit(0), "v", ["n"])
    assert empty.count() == 0


def test_features_of_operational_tables(spark, tables):
    users, log = tables
    days = [(1, later(d), 100.0 + d) for d in range(-40, 6)]
    snapshots = spark.createDataFrame(days, "user_id long, snapshot_date date, portfolio_value double")
    rows = {r.user_id: r for r in user_features(users, log, snapshots, AS_OF).collect()}
    assert rows[1].portfolio_return_30d == pytest.approx(30 / 70 * 100)
    assert rows[2].portfolio_return_30d == 0 and rows[2].days_since_login == 50
    assert rows[4].account_age_days == 0 and rows[4].trading_intensity is None
    assert [rows[i].churned for i in (1, 2, 4)] == [0, 1, 0]


def test_unknown_inputs_are_filled_and_counted(spark, small_dir):
    features = Tables(spark, small_dir).learnable_user_features()
    holes = features.withColumn("trading_intensity", F.when(F.col("user_id") % 50 != 3, F.col("trading_intensity")))
    prepared = training.prepare(holes)
    assert prepared.filled == {"trading_intensity": holes.filter("trading_intensity IS NULL").count()}
    assert prepared.part("train").count() > 0
    with pytest.raises(ValueError, match="portfolio_value"):
        training.prepare(features.withColumn("portfolio_value", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="churned"):
        training.prepare(features.withColumn("churned", F.when(F.col("user_id") > 5, F.col("churned"))))


def test_a_store_of_days(spark, small_dir, tmp_path):
    t = Tables(spark, small_dir)
    path = str(tmp_path / "scores")
    stores.write_scores(t.scores_on(t.as_of), path)
    stores.write_scores(t.scores_on(t.as_of - timedelta(days=9)), path)
    rows = stores.read_scores(spark, path)
    assert [f.simpleString() for f in rows.schema.fields][:-1] == [
        f.simpleString() for f in t.scores_on(t.as_of).schema.fields
    ]
    assert stores.read_scores(spark, path, since=t.as_of).count() == t.scores_on(t.as_of).count()
