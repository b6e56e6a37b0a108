"""Model training on the medium tables: parity of the linear model, quality of the others."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.bindings import Tables
from holdfast.operators import metrics
from holdfast.plans import training
from holdfast.sources import stores


@pytest.fixture(scope="module")
def models(spark, medium_dir):
    return training.Training(training.prepare(Tables(spark, medium_dir).learnable_user_features()))


def matrix(part):
    rows = part.select("label", "balanced", vector_to_array("features").alias("x")).collect()
    return np.array([r.x for r in rows]), np.array([r.label for r in rows]), np.array([r.balanced for r in rows])


def test_train_part_is_standardised(models):
    x, _, weights = matrix(models.data.part("train"))
    assert x.shape[1] == 17
    assert abs(x.mean(axis=0)).max() < 1e-9
    assert abs(x.std(axis=0) - 1).max() < 1e-9
    assert weights.sum() == pytest.approx(len(x))


def test_logistic_matches_newton(models):
    x, y, w = matrix(models.data.part("train"))
    a = np.c_[x, np.ones(len(x))]
    penalty = np.diag([1 / training.INVERSE_REGULARIZATION] * x.shape[1] + [0.0])
    theta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ theta))
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        theta -= np.linalg.solve(hessian, a.T @ (w * (p - y)) + penalty @ theta)
    model = models.model("logistic_regression")
    assert np.abs(model.coefficients.toArray() - theta[:-1]).max() < 1e-5
    assert model.intercept == pytest.approx(theta[-1], abs=1e-5)


def test_attributions_add_up(spark, models):
    model = models.model("logistic_regression")
    test = models.data.part("test")
    table = training.linear_attribution(model, test, models.data.features, n=50)
    per_row = {r.user_id: r.total for r in table.groupBy("user_id").agg(F.sum("attribution").alias("total")).collect()}
    assert len(per_row) == 50
    scored = training.score(model, test, "m", "user_id").collect()
    logit = {r.user_id: np.log(r.score / (1 - r.score)) for r in scored if r.user_id in per_row}
    base = np.mean(list(logit.values()))
    for user, total in per_row.items():
        assert total == pytest.approx(logit[user] - base, abs=1e-6)


@pytest.mark.parametrize("name", training.MODEL_ORDER)
def test_models_learn(models, name):
    row = metrics.summary(models.scored(name, "test")).collect()[0]
    assert row.auc_roc > 0.6


def test_best_model_and_reports(spark, models):
    best = models.best().collect()[0]
    table = {r.model: r.auc_roc for r in models.comparison().collect()}
    assert set(table) == set(training.MODEL_ORDER)
    assert round(best.auc_roc, 4) == max(table.values())
    evaluation = {r.metric: r.value for r in models.test_evaluation(best.model).collect()}
    rows = models.data.part("test").count()
    assert evaluation["Retained support"] + evaluation["Churned support"] == rows


def test_patience():
    falling = [1.0 - i / 100 for i in range(50)]
    assert training.best_round(falling) == 50
    assert training.best_round([3, 2, 1] + [2] * 20 + [0]) == 3
    assert training.best_round([3, 2, 1] + [2] * 9 + [0]) == 13


def test_permutation_uses_every_value_once(spark, models):
    model = models.model("logistic_regression")
    table = training.permutation_importance(model, models.data.part("test"), models.data.features)
    rows = table.collect()
    assert {r.feature for r in rows} == set(models.data.features)
    assert rows[0].importance > 0.01
    plain = metrics.auc_roc(models.scored("logistic_regression", "test")).collect()[0].auc_roc
    assert all(r.auc_roc == pytest.approx(plain) for r in rows)


def test_saved_model_scores_the_wide_table(spark, models, tmp_path):
    name = "logistic_regression"
    path = stores.save_model(models.full_model(name), str(tmp_path / "model"))
    raw = models.data.rows.filter("split = 'test'").drop("segment_encoded", "account_stage_encoded")
    loaded = training.score(stores.load_model(path), raw.withColumn("label", F.col("churned")), name, "user_id")
    direct = {r.user_id: r.score for r in models.scored(name, "test").collect()}
    again = {r.user_id: r.score for r in loaded.collect()}
    assert again == pytest.approx(direct)


def test_unknown_model_kind_is_refused(spark, models):
    with pytest.raises(ValueError):
        training.feature_importance(spark, models.model("logistic_regression"), models.data.features, "other")


def boosting_data(spark, noisy):
    """Rows whose label follows ``x``, or nothing: then every round makes the unseen rows' loss worse."""
    rows = [(i, float((i * 37 % 101 > 50) ^ (noisy and i * i % 7 < 3)), float(i * 37 % 101), float(i * 53 % 89)) for i in range(600)]
    table = spark.createDataFrame(rows, "i INT, label DOUBLE, x DOUBLE, y DOUBLE").repartition(3, "i")
    if noisy:
        table = table.withColumn("x", F.col("y"))
    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(table)
    ready = ready.withColumn("positive", F.lit(1.0))
    parts = {"train": ready.filter("i % 3 > 0"), "val": ready.filter("i % 3 = 0")}
    return SimpleNamespace(part=parts.get, fit_rows=parts["train"])


@pytest.mark.parametrize(("noisy", "fitted"), [(True, [20]), (False, [20, 26])])
def test_boosting_fits_no_round_past_its_patience(spark, monkeypatch, noisy, fitted):
    monkeypatch.setitem(training.BOOSTING, "maxIter", 26)
    data, asked = boosting_data(spark, noisy), []

    class Counted(GBTClassifier):
        def fit(self, rows):
            asked.append(self.getMaxIter())
            return super().fit(rows)

    monkeypatch.setattr(training, "GBTClassifier", Counted)
    kept = training.fit_boosting(data)
    assert asked == fitted

    monkeypatch.setattr(training, "FIRST_ROUNDS", 26)
    whole = training.fit_boosting(data)
    assert kept.getNumTrees == whole.getNumTrees
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees]


def test_fits_read_no_more_partitions_than_cores(spark, monkeypatch):
    rows = spark.range(400).repartition(40)
    cores = spark.sparkContext.defaultParallelism
    assert training.gathered(rows, 400).rdd.getNumPartitions() == cores
    assert training.gathered(spark.range(0, 400, 1, 3), 400).rdd.getNumPartitions() == 3
    monkeypatch.setattr(training, "FIT_ROWS", 20)
    few = training.gathered(rows, 400)
    assert few.rdd.getNumPartitions() == max(cores, 20)
    assert few.count() == 400
