"""Mergeable sets, interval joins, radix selection, daily state, typed CSV, resampling, cut ensembles."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.operators import distinct, intervals, profile, radix, resampling
from holdfast.plans import daily, training
from holdfast.plans.campaigns import ab_bootstrap
from holdfast.sources import typed_csv
from oracles import sql as oracles

c = F.col
DAY = date(2024, 1, 1)


def later(n):
    return DAY + timedelta(days=n)


def test_sets_merge_to_distinct_counts(spark):
    """Keys of several buckets, negative and unknown ones, and a key with two fifths of the rows."""
    draw = random.Random(1)
    keys = [draw.choice([7, 7, draw.randrange(-50_000, 200_000), None, 40_000]) for _ in range(3000)]
    rows = [(k, draw.choice("ab"), later(draw.randrange(4)), draw.random() < 0.5) for k in keys]
    df = spark.createDataFrame(rows, "k BIGINT, g STRING, d DATE, hit BOOLEAN")
    sets = distinct.key_bitmaps(df, "k", ["g", "d"], {"n": F.lit(True), "hits": c("hit")})
    levels = {"both": ["g", "d"], "g": ["g"], "all": []}
    got = {(r.level, r.g, r.d): (r.n, r.hits) for r in distinct.rolled_up(sets, levels, ["n", "hits"]).collect()}
    want = defaultdict(lambda: (set(), set()))
    for k, g, d, hit in rows:
        for place in (("both", g, d), ("g", g, None), ("all", None, None)):
            if k is not None:
                want[place][0].add(k)
                if hit:
                    want[place][1].add(k)
    assert got == {place: tuple(map(len, found)) for place, found in want.items()}
    days = {r.d: r.n for r in distinct.trailing(sets, "d", 2, ["n"], F.lit(later(3))).collect()}
    for i in range(4):
        assert days[later(i)] == len({k for k, _, d, _ in rows if k is not None and d in (later(i), later(i - 1))})


@pytest.mark.parametrize("width", [1, 7, 400])
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_joins_find_each_pair_once(spark, width, keyed):
    draw = random.Random(width)
    spans = [(i, draw.randrange(3), later(s := draw.randrange(-900, 900)), later(s + draw.randrange(-2, 30))) for i in range(60)]
    points = [(i, draw.randrange(3), later(draw.randrange(-900, 900))) for i in range(80)] + [(99, 1, None)]
    left = spark.createDataFrame(spans + [(98, 1, None, DAY)], "a INT, k INT, lo DATE, hi DATE")
    right = spark.createDataFrame(points, "b INT, k INT, d DATE")
    if not keyed:
        right = right.withColumnRenamed("k", "other")
    got = intervals.interval_join(left, right, "lo", "hi", "d", width, ["k"] if keyed else [])
    want = [(i, j) for i, k, lo, hi in spans for j, m, d in points if d and lo <= d <= hi and (not keyed or k == m)]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
            float("inf"), float("-inf"), 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), -1.0, 0.1]


def test_keys_order_like_numbers_and_come_back(spark):
    draw = random.Random(2)
    values = EXTREMES + [draw.uniform(-1, 1) * 10.0 ** draw.randint(-307, 307) for _ in range(500)]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 13)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", radix.ordered_key(c("v")).alias("k"))
    rows = df.withColumn("back", radix.keyed_value(c("k"))).collect()
    assert all(r.back == r.v for r in rows)
    by_key = sorted(rows, key=lambda r: r.k)
    assert [r.v for r in by_key] == sorted(r.v for r in rows)
    assert len({r.k for r in rows}) == len({r.v for r in rows})


def test_radix_quantiles_match_numpy(spark):
    draw = np.random.default_rng(3)
    groups = {
        "spread": draw.normal(size=400) * np.exp(draw.normal(size=400) * 20),
        "tied": np.repeat([1.5, 2.5], [300, 7]),
        "one": np.array([-3.25]),
        "whole": draw.integers(-5, 5, 99).astype(float),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("tied", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r.g: r for r in radix.radix_quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(values, share * 100), rel=1e-12, abs=0)
    (alone,) = radix.radix_quantiles(df, "x", {"m": 0.5}).collect()
    assert alone.m == pytest.approx(np.median(np.concatenate([*groups.values(), [1.0]])))
    assert radix.radix_quantiles(df.limit(0), "x", {"m": 0.5}, ["g"]).collect() == []


def test_rings_equal_the_lag_over_all_history(spark, tmp_path):
    """Users who come late or skip days: the lag counts rows."""
    draw = random.Random(4)
    rows = [(u, later(d), draw.uniform(1, 9)) for u in range(6) for d in range(draw.randrange(9), 20) if u < 4 or draw.random() < 0.6]
    df = spark.createDataFrame(rows, "user_id BIGINT, snapshot_date DATE, portfolio_value DOUBLE")
    days = [later(d) for d in range(12, 20)]
    daily.first_ring(df, later(11), str(tmp_path), lag=5)
    for day in days:
        daily.advance_ring(spark, df, day, str(tmp_path), lag=5)
    daily.advance_ring(spark, df, days[-1], str(tmp_path), lag=5)  # again: the same folder
    history, want = defaultdict(list), {}
    for u, d, v in sorted(rows):
        if d in days:
            old = history[u][-5] if len(history[u]) >= 5 else None
            want[u, d] = None if old is None else (v - old) / old * 100
        history[u].append(v)
    got = {(r.user_id, r.snapshot_date): r.portfolio_return_30d for r in daily.returns_of(spark, str(tmp_path), days).collect()}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_slid_windows_equal_full_scans(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 2, 3]), draw.uniform(1, 5), later(draw.randrange(0, 70))) for _ in range(300)]
    trades = spark.createDataFrame(rows, "user_id BIGINT, trade_amount DOUBLE, trade_date DATE")
    from holdfast.sources import stores

    deltas, state = str(tmp_path / "deltas"), str(tmp_path / "state")
    stores.write_days(daily.daily_trades(trades), deltas)
    changes = spark.read.schema(daily.DELTA_SCHEMA).parquet(deltas)
    days = [later(d) for d in range(40, 46)]
    daily.first_windows(changes, later(39), state)
    for day in [*days, days[-1]]:  # the last one twice
        daily.advance_windows(spark, deltas, day, state)
    got = {(r.day, r.user_id): r for r in daily.windows_of(spark, state, days).collect()}
    for day in days:
        for u in (1, 2, 3):
            back = [(day - d).days for v, _, d in rows if v == u]
            amounts = [a for v, a, d in rows if v == u and 0 <= (day - d).days <= 30]
            recent, prior = (sum(lo <= b <= hi for b in back) for lo, hi in ((0, 14), (14, 28)))
            if amounts:
                r = got.pop((day, u))
                assert (r.trades_30d, r.avg_trade_size) == (len(amounts), pytest.approx(np.mean(amounts)))
                assert r.trade_freq_trend == (pytest.approx((recent - prior) / prior) if prior else None)
    assert got == {}


def csv(spark, tmp_path, text):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text(text)
    return typed_csv.read_cells(spark, str(tmp_path / "t"))


def test_types_are_the_narrowest_that_fit(spark, tmp_path):
    cells = csv(spark, tmp_path, (
        "i,b,x,d,t,f,s,e,m\n"
        "1,3000000000,1.5,2024-02-29,2024-01-01 10:00:00,true,a,,1\n"
        "-7,2,2e3,2023-01-01,2024-01-01T10:00,FALSE,2024-01-01,,x\n"
        ",,,,,,,,\n"
        "1,2\n"
        "1,2,3,2024-01-01,2024-01-01 00:00:00,true,a,,3,extra\n"
    ))
    got = {r.column_name: (r.type, r.n_values, r.n_null, r.n_bad) for r in typed_csv.column_types(cells).collect()}
    assert got == {
        "i": ("int", 2, 1, 0), "b": ("bigint", 2, 1, 0), "x": ("double", 2, 1, 0), "d": ("date", 2, 1, 0),
        "t": ("timestamp_ntz", 2, 1, 0), "f": ("boolean", 2, 1, 0), "s": ("string", 2, 1, 0),
        "e": ("string", 0, 3, 0), "m": ("string", 2, 1, 0),
    }
    kinds = {name: kind for name, (kind, *_) in got.items()}
    bad = typed_csv.quarantine(typed_csv.typed(cells, kinds)).collect()
    assert sorted(r.column_name for r in bad) == [typed_csv.RECORD] * 2
    assert {r.cell for r in bad} == {"1,2", "1,2,3,2024-01-01,2024-01-01 00:00:00,true,a,,3,extra"}


def test_a_tolerance_keeps_what_misses_the_type(spark, tmp_path):
    cells = csv(spark, tmp_path, "n,d\n" + "\n".join(f"{i},2024-01-0{i}" for i in range(1, 9)) + "\nx,2024-02-30\n")
    assert {r.type for r in typed_csv.column_types(cells).collect()} == {"string"}
    table = typed_csv.read_typed_csv(spark, str(tmp_path / "t"), 0.2)
    assert [k for _, k in table.dtypes[:2]] == ["int", "date"]
    assert {(r.column_name, r.cell) for r in typed_csv.quarantine(table).collect()} == {("n", "x"), ("d", "2024-02-30")}
    assert table.filter("n IS NULL").count() == 1


def test_weights_are_poisson_and_the_same_everywhere(spark):
    assert f"u >= {resampling.poisson_steps()[3]}" in oracles.bootstrap()
    assert oracles.bootstrap().count("u >=") == 2 * len(resampling.poisson_steps())
    df = spark.range(2000).select(F.inline(resampling.replicate_weights("id", 8)))
    counts = {r.weight: r["count"] for r in df.groupBy("weight").count().collect()}
    for k in range(4):
        assert counts[k] / 16_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)
    with pytest.raises(ValueError):
        resampling.replicate_weights("id", 6)


def test_rates_follow_the_weights_and_the_work_is_dealt_out(spark):
    rows = spark.range(60).select("id", F.when(c("id") % 2 == 0, "a").alias("variant"), F.when(c("id") % 5 > 0, c("id") % 5 == 1).alias("hit"))
    rows = rows.unionByName(rows.filter("id < 9")).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("long"))).coalesce(1)
    got = resampling.bootstrap_rates(rows, "id", ["variant"], c("hit"), 8)
    each = rows.select("variant", F.coalesce("hit", F.lit(False)).alias("hit"), F.inline(resampling.replicate_weights("id", 8)))
    n, hits = F.sum("weight"), F.sum(F.when(c("hit"), c("weight")).otherwise(0))
    want = each.groupBy("variant", "replicate").agg((hits / n).alias("rate"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 16
    # A row's weights are made by compiled code, in as many tasks as a shuffle has.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Repartition" in plan


def test_intervals_hold_the_rate_and_have_a_width_at_zero(spark):
    users = spark.range(600).select(c("id").alias("user_id"), F.when(c("id") % 6 == 1, later(5)).alias("churned_date"))
    enrolled = spark.range(600).select(
        c("id").alias("user_id"), F.lit("t").alias("test_name"),
        F.when(c("id") % 2 == 0, "control").otherwise("new").alias("variant"), F.lit(DAY).alias("enrolled_date"),
    )
    rows = {r.variant: r for r in ab_bootstrap(enrolled, users, later(40), "t").collect()}
    new, control = rows["new"], rows["control"]
    assert new.churn_rate == pytest.approx(1 / 3) and new.ci_lower < 1 / 3 < new.ci_upper
    spread = 1.96 * math.sqrt(2 / 9 / 300)
    assert new.ci_upper - new.ci_lower == pytest.approx(2 * spread, rel=0.25)
    assert (control.churn_rate, control.ci_upper) == (0.0, 0.0) and control.wilson_upper > 0.01
    assert new.lift == pytest.approx(1 / 3) and new.lift_lower > 0.2


def test_pairs_count_the_rows_that_know_both(spark):
    rows = [(1.0, 2.0, None, 5.0), (2.0, None, 3.0, 5.0), (3.0, 5.0, 1.0, 5.0), (4.0, 4.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, k DOUBLE")
    got = {(r.feature_a, r.feature_b): (r.correlation, r.n) for r in profile.comoment_matrix(df, df.columns).collect()}
    assert len(got) == 16 and got["a", "k"] == (None, 4)
    for x, y in (("a", "b"), ("b", "c"), ("c", "a")):
        both = [(r["abck".index(x)], r["abck".index(y)]) for r in rows]
        both = np.array([p for p in both if None not in p])
        assert got[x, y][1] == len(both) and got[x, y] == got[y, x]
        assert got[x, y][0] == pytest.approx(np.corrcoef(both.T)[0, 1])


def test_a_cut_ensemble_scores_like_a_short_one(spark):
    draw = np.random.default_rng(6)
    rows = [(float(a), float(b), float(a * b + draw.normal() > 0)) for a, b in draw.normal(size=(300, 2))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, label DOUBLE"))
    trainer = GBTClassifier(maxIter=6, maxDepth=3, seed=1, subsamplingRate=0.8, featureSubsetStrategy="0.8")
    cut = training.first_trees(trainer.fit(df), 3)
    short = trainer.copy({trainer.maxIter: 3}).fit(df)
    assert cut.getNumTrees == short.getNumTrees == 3 and list(cut.treeWeights) == list(short.treeWeights)
    first, second = ([r.probability[1] for r in m.transform(df).collect()] for m in (cut, short))
    assert first == pytest.approx(second)
