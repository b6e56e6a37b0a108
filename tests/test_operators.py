"""Ordering, profiles, metrics, splits, series and stores against brute force."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from holdfast.__main__ import run
from holdfast.operators import market, metrics, profile
from holdfast.operators.ordering import exact_quantiles, hashed_rank, hashed_sample, per_value, running_totals
from holdfast.operators.sampling import class_weights, stratified_split
from holdfast.plans import training
from holdfast.sources import stores


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def numbers(spark, rows, schema="g STRING, x DOUBLE"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_sort(spark, descending):
    rng = random.Random(1)
    # A third of the rows share one value; the groups have very different ranges.
    rows = [("a", 5.0) for _ in range(400)]
    rows += [("a", round(rng.expovariate(0.01), 2)) for _ in range(500)]
    rows += [("b", float(rng.randrange(10**6))) for _ in range(300)] + [("b", None)]
    distinct = per_value(numbers(spark, rows), "x", {"n": F.lit(1), "s": F.col("x")}, by=["g"])
    result = running_totals(distinct, "x", ["n", "s"], by=["g"], descending=descending)
    got = {(r.g, r.x): (r.n, r.cum_n, r.total_n, r.cum_s) for r in result.collect()}
    for g in "ab":
        values = sorted((x for h, x in rows if h == g and x is not None), reverse=descending)
        seen = 0
        for x in dict.fromkeys(values):
            n = values.count(x)
            seen += n
            assert got[g, x][:3] == (n, seen, len(values))
            assert got[g, x][3] == pytest.approx(sum(values[:seen]))
    assert len(got) == len({r for r in rows if r[1] is not None})


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1e4, 999), np.zeros(500), rng.normal(3, 1e-6, 777)])
    df = numbers(spark, [("a", float(v)) for v in values])
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    row = only(exact_quantiles(df, "x", shares))
    for name, share in shares.items():
        assert row[name] == pytest.approx(np.percentile(values, share * 100), abs=1e-9)


def test_quantile_interpolates(spark):
    df = numbers(spark, [("a", v) for v in (1.0, 2.0, 3.0, 10.0)])
    assert only(exact_quantiles(df, "x", {"p": 0.9})).p == pytest.approx(7.9)


def test_hashed_rank_numbers_each_group(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 7 == 0).cast("int"))
    rows = hashed_rank(df, "id", by=["g"]).orderBy(F.md5(F.col("id").cast("string"))).collect()
    for g in (0, 1):
        ranks = [r["rank"] for r in rows if r.g == g]
        assert ranks == list(range(1, len(ranks) + 1))
        assert {r["size"] for r in rows if r.g == g} == {len(ranks)}


def test_sample_is_reproducible_and_whole_if_small(spark):
    big, small = spark.range(5000), spark.range(10)
    first = {r.id for r in hashed_sample(big, "id", 1000).collect()}
    again = {r.id for r in hashed_sample(big.repartition(3), "id", 1000).collect()}
    assert len(first) == 1000 and first == again
    assert hashed_sample(small, "id", 1000).count() == 10


def test_split_is_exact_and_stratified(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    split = stratified_split(df, "id", "y")
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    for y, n in ((0, 857), (1, 143)):
        assert abs(counts[y, "test"] - 0.2 * n) <= 1
        assert abs(counts[y, "val"] - 0.1 * n) <= 1
    assert sum(counts.values()) == 1000
    again = stratified_split(df.repartition(5), "id", "y")
    assert split.exceptAll(again).count() == 0


def test_class_weights(spark):
    df = spark.range(10).withColumn("y", (F.col("id") < 2).cast("int"))
    rows = {r.label: r for r in class_weights(df, "y").collect()}
    assert (rows[0].balanced_weight, rows[1].balanced_weight) == (0.625, 2.5)
    assert rows[0].scale_pos_weight == rows[1].scale_pos_weight == 4.0


TIED = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (0.1, 0)]


def scored(spark, rows, model="m"):
    return spark.createDataFrame(
        [(model, s, y, int(s >= 0.5)) for s, y in rows],
        "model STRING, score DOUBLE, label INT, prediction INT",
    )


def test_area_and_precision_under_ties(spark):
    df = scored(spark, TIED)
    assert only(metrics.auc_roc(df)).auc_roc == pytest.approx(0.722222, abs=1e-6)
    assert only(metrics.average_precision(df)).average_precision == pytest.approx(0.755556, abs=1e-6)


def test_area_matches_the_built_in_evaluator(spark):
    rng = random.Random(3)
    rows = [(round(rng.random() * 0.7 + 0.3 * y, 2), y) for y in (rng.randrange(2) for _ in range(2000))]
    df = scored(spark, rows)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    expected = evaluator.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert only(metrics.auc_roc(df)).auc_roc == pytest.approx(expected)
    flipped = df.withColumn("score", -F.col("score"))
    assert only(metrics.auc_roc(flipped)).auc_roc == pytest.approx(1 - expected)


def brute_top(rows, share):
    scores = np.array([s for s, _ in rows])
    labels = np.array([y for _, y in rows])
    cut = np.percentile(scores, 100 * (1 - share))
    return cut, int((scores >= cut).sum()), labels[scores >= cut].mean()


@pytest.mark.parametrize("n", [5, 11, 100, 997])
def test_precision_at_top_keeps_ties(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(n)]
    row = only(metrics.precision_at_top(scored(spark, rows)))
    cut, selected, precision = brute_top(rows, 0.1)
    assert row.threshold == pytest.approx(cut)
    assert (row.n_selected, row.precision_at_10pct) == (selected, pytest.approx(precision))


def test_models_are_measured_side_by_side(spark):
    rng = random.Random(5)
    other = [(rng.random(), rng.randrange(2)) for _ in range(300)]
    both = scored(spark, TIED, "a").unionByName(scored(spark, other, "b"))
    together = {r.model: r for r in metrics.summary(both).collect()}
    for name, rows in (("a", TIED), ("b", other)):
        alone = only(metrics.summary(scored(spark, rows, name))).asDict()
        assert together[name].asDict() == {
            k: v if k == "model" else pytest.approx(v) for k, v in alone.items()
        }
    assert together["a"].precision == pytest.approx(2 / 3)
    assert together["a"].recall == pytest.approx(2 / 3)


def test_curves_start_and_end_right(spark):
    roc = metrics.roc_curve(scored(spark, TIED)).orderBy("fpr", "tpr").collect()
    assert (roc[0].threshold, roc[0].fpr, roc[0].tpr) == (None, 0.0, 0.0)
    assert (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)
    assert len(roc) == 6
    pr = metrics.pr_curve(scored(spark, TIED)).orderBy("recall").collect()
    assert (pr[0].threshold, pr[0].precision, pr[0].recall) == (None, 1.0, 0.0)
    assert {r.baseline for r in pr} == {0.5}


def test_undefined_rates_are_zero(spark):
    df = scored(spark, [(0.1, 1), (0.2, 0)])
    row = only(metrics.summary(df))
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    cells = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_absent_group_stays_in_the_domain(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("c", 1), (None, 1)], "k STRING, churned INT")
    rows = profile.complete(profile.rate_by(df, "k"), "k", ("c", "b", "a")).collect()
    assert [(r.k, r.churn_rate, r.n_users) for r in rows] == [("c", 1.0, 1), ("b", None, 0), ("a", 0.5, 2)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame(
        [(0, float(x)) for x in range(31)] + [(1, 4.0), (1, 4.0)], "churned INT, x DOUBLE"
    )
    rows = {(r.churned, r.bin): r.n for r in profile.histogram(df, "x", "churned").collect()}
    expected, _ = np.histogram(np.arange(31.0), bins=30)
    assert [rows[0, b] for b in range(1, 31)] == list(expected)
    flat, _ = np.histogram([4.0, 4.0], bins=30)
    assert [rows[1, b] for b in range(1, 31)] == list(flat)


def test_boxplot_finds_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(0, v) for v in values], "churned INT, x DOUBLE")
    row = only(profile.boxplot(df, "x", "churned"))
    assert (row.q1, row["median"], row.q3) == (2.25, 3.5, 4.75)
    assert (row.whisker_lo, row.whisker_hi, row.n_outliers) == (1.0, 5.0, 1)


def test_correlation_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 1.0), (3.0, 6.5, 2.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    rows = {(r.feature_a, r.feature_b): r.correlation for r in profile.correlation_matrix(df, "abc").collect()}
    assert len(rows) == 9
    assert rows["a", "c"] == rows["c", "a"] and rows["b", "b"] == pytest.approx(1.0)


def test_label_codes_are_alphabetical(spark):
    stages = ["new", "growing", "established", "mature", "veteran", "veteran"]
    df = spark.createDataFrame([(s,) for s in stages], "account_stage STRING")
    rows = training.fit_encoder(df, ["account_stage"]).transform(df).collect()
    codes = {r.account_stage: int(r.account_stage_encoded) for r in rows}
    assert codes == {"established": 0, "growing": 1, "mature": 2, "new": 3, "veteran": 4}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "a DOUBLE, k DOUBLE")
    rows = training.fit_scaler(df, ["a", "k"]).transform(df).collect()
    assert [r.a_scaled for r in rows] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [r.k_scaled for r in rows] == [0.0, 0.0, 0.0]


def test_scaler_writes_tiny_and_negative_numbers(spark):
    values = [-3e-17, 1e-9, -2.5e-8]
    df = spark.createDataFrame([(v,) for v in values], "a DOUBLE")
    rows = training.fit_scaler(df, ["a"]).transform(df).collect()
    expected = (np.array(values) - np.mean(values)) / np.std(values)
    assert [r.a_scaled for r in rows] == pytest.approx(list(expected))


def test_volatility_needs_a_full_window(spark):
    rows = [("X", date(2024, 1, 1) + timedelta(days=i), 0.01 * (i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "asset STRING, date DATE, daily_return DOUBLE")
    result = market.rolling_volatility(df).orderBy("date").collect()
    assert [r.raw_volatility is None for r in result] == [True] * 6 + [False] * 3
    known = [r.raw_volatility for r in result[6:]]
    assert known[0] == pytest.approx(np.std([r[2] for r in rows[:7]], ddof=1) * np.sqrt(365))
    assert result[0].volatility == pytest.approx(np.mean(known))
    prices = [r.price for r in market.price_index(df).orderBy("date").collect()]
    assert prices == pytest.approx(list(40000 * np.exp(np.cumsum([r[2] for r in rows]))))


def test_csv_keeps_unknown_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, None, None)], "id BIGINT, s STRING, x DOUBLE")
    path = str(tmp_path / "table")
    stores.write_csv(df, path)
    back = stores.read_csv(spark, path, "id BIGINT, s STRING, x DOUBLE")
    assert sorted(back.collect()) == sorted(df.collect())


def test_rerun_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "scores")

    def run(day, ids):
        rows = [(i, datetime(2024, 1, day)) for i in ids]
        return spark.createDataFrame(rows, "user_id BIGINT, scored_at TIMESTAMP_NTZ")

    stores.write_scores(run(30, [1, 2]).unionByName(run(31, [1, 2])), path)
    stores.write_scores(run(31, [3]), path)
    stored = stores.read_scores(spark, path)
    assert {(r.user_id, r.scored_at.day) for r in stored.collect()} == {(1, 30), (2, 30), (3, 31)}
    pruned = stores.read_scores(spark, path, since=date(2024, 1, 31))
    assert [r.user_id for r in pruned.collect()] == [3]
    assert "PartitionFilters: [isnotnull(score_date" in pruned._jdf.queryExecution().toString()


def test_reports_are_stored_by_name(spark, small_dir, tmp_path):
    run(spark, small_dir, str(tmp_path), ["churn_by_risk", "auc_roc"])
    assert spark.read.parquet(str(tmp_path / "churn_by_risk")).count() == 3
    assert spark.read.parquet(str(tmp_path / "auc_roc")).count() == 1
    with pytest.raises(SystemExit):
        run(spark, small_dir, str(tmp_path), ["no such report"])
