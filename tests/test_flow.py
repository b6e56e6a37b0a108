"""Scoring, storing, targeting and monitoring in sequence."""

from datetime import timedelta

from holdfast.bindings import Tables
from holdfast.plans import campaigns
from holdfast.sources import stores


def test_targets_from_the_store_match_direct_ones(spark, small_dir, tmp_path):
    t = Tables(spark, small_dir)
    path = str(tmp_path / "scores")
    stores.write_scores(t.recent_scores(), path)
    stores.write_scores(t.scores_on(t.as_of - timedelta(days=20)), path)

    stored = stores.read_scores(spark, path)
    targets = campaigns.high_risk_targets(stored, t.users(), t.as_of)
    direct = campaigns.high_risk_targets(t.recent_scores(), t.users(), t.as_of)
    assert targets.collect() == direct.collect()

    read = targets._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(score_date" in read


def test_stored_scores_can_be_monitored(spark, small_dir, tmp_path):
    t = Tables(spark, small_dir)
    path = str(tmp_path / "scores")
    run_day = t.as_of - timedelta(days=35)
    stores.write_scores(t.scores_on(run_day, null_trend=0.0), path)
    rows = campaigns.model_calibration(stores.read_scores(spark, path), t.users(), t.as_of).collect()
    assert {row.prediction_date for row in rows} == {run_day}
    # Users who signed up after the run were not scored on it.
    assert sum(row.total_predictions for row in rows) == t.activity(as_of=run_day).count()
    for row in rows:
        assert 0 <= row.avg_predicted_prob <= 1
        assert (row.high_risk_precision is None) == (row.risk_tier != "high")
