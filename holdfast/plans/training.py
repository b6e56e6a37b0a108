"""Preparing the feature table, training three classifiers on it, and judging them."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from holdfast.config import CATEGORICAL, MODEL_FEATURES
from holdfast.operators import metrics
from holdfast.operators.ordering import hashed_rank, hashed_sample
from holdfast.operators.sampling import class_weights, stratified_split
from holdfast.plans.scoring import interaction_features, user_segments
from holdfast.session import fresh_path, materialize

c = F.col

SEED = 42
KEY = "user_id"
LABEL = "churned"

# Model names in training order, and their settings.
MODEL_ORDER = ("logistic_regression", "random_forest", "gradient_boosting")
INVERSE_REGULARIZATION = 0.1
LOGISTIC_ITERATIONS = 1000
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 50}
BOOSTING = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8}
BOOSTING_COLUMN_SHARE = "0.8"
PATIENCE = 10
FIRST_ROUNDS = 2 * PATIENCE

# Trees are grown level by level; a larger buffer means fewer passes over the data per level.
TREE_BUFFER_MB = 512

# Rows that one task of a fit may hold beyond a task per core.
FIT_ROWS = 500_000


def fit_encoder(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> StringIndexerModel:
    """Alphabetical integer codes. A label unseen in fitting gets the next free code."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{name}_encoded" for name in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(df)


def fit_scaler(train: DataFrame, columns: Sequence[str] = MODEL_FEATURES) -> SQLTransformer:
    """Standardisation by mean and population deviation; a constant column becomes 0.

    ``StandardScaler`` divides by the sample deviation. The fitted numbers are literals of a
    SQL stage, so they are saved with the model. One pass, two numbers per feature.
    """
    fitted = train.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in columns],
        *[F.stddev_pop(name).alias(f"std_{name}") for name in columns],
    ).first()
    unknown = [name for name in columns if fitted[f"mean_{name}"] is None]
    if unknown:
        raise ValueError(f"no training row has a value of: {', '.join(unknown)}")
    scaled = [
        f"(`{name}` - {fitted[f'mean_{name}']!r}D) / {(fitted[f'std_{name}'] or 1.0)!r}D"
        f" AS `{name}_scaled`"
        for name in columns
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


@dataclass(frozen=True)
class Prepared:
    """The split feature table and the fitted transformations of its model inputs."""

    rows: DataFrame
    encoder: StringIndexerModel
    scaler: SQLTransformer
    features: tuple[str, ...]
    class_counts: dict[int, int]
    class_weight: dict[int, float]
    imbalance: float
    filled: dict[str, int] = field(default_factory=dict)

    @property
    def assembler(self) -> VectorAssembler:
        inputs = [f"{name}_scaled" for name in self.features]
        return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")

    def part(self, name: str) -> DataFrame:
        """Model matrix of one split. The table is stored by split: only its files are read."""
        rows = self.rows.filter(c("split") == name)
        is_one = c(LABEL) == 1
        return self.assembler.transform(self.scaler.transform(rows)).select(
            KEY,
            c(LABEL).cast("double").alias("label"),
            "features",
            F.when(is_one, self.class_weight[1]).otherwise(self.class_weight[0]).alias("balanced"),
            F.when(is_one, self.imbalance).otherwise(1.0).alias("positive"),
        )

    @property
    def fit_rows(self) -> DataFrame:
        """The training rows as the fits read them."""
        return gathered(self.part("train"), sum(self.class_counts.values()))

    @property
    def segments(self) -> DataFrame:
        """The feature table with risk and value segments."""
        return user_segments(self.rows)

    @property
    def stages(self) -> list[Transformer]:
        return [self.encoder, self.scaler, self.assembler]


def fill_unknown(
    features: DataFrame, columns: Sequence[str], value: float = 0.0
) -> tuple[DataFrame, dict[str, int]]:
    """``features`` with NULL model inputs replaced, and how many each column had.

    A column without any value is an error, as is a NULL label: a fill would hide that the
    table is wrong. One pass.
    """
    counted = features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(LABEL).alias("labelled"),
        *[F.count(name).alias(f"known_{name}") for name in columns],
    ).first()
    if counted["labelled"] < counted["rows"]:
        raise ValueError(f"{counted['rows'] - counted['labelled']} rows have no {LABEL}")
    unknown = {name: counted["rows"] - counted[f"known_{name}"] for name in columns}
    empty = [name for name, n in unknown.items() if n == counted["rows"]]
    if empty:
        raise ValueError(f"no row has a value of: {', '.join(empty)}")
    filled = {name: n for name, n in unknown.items() if n}
    return features.fillna(value, list(filled)) if filled else features, filled


def prepare(features: DataFrame, columns: Sequence[str] = MODEL_FEATURES) -> Prepared:
    """Split the feature table and fit encoder, scaler and class weights.

    Two tables are written: the features, which the split reads twice, and the split rows,
    which the fits pass over many times. A lost executor sends neither back to the joins.
    Everything after the second table is a projection. NULL model inputs are filled with 0;
    ``Prepared.filled`` tells how many.
    """
    stored = materialize(interaction_features(features), "features")
    full, filled = fill_unknown(stored, [name for name in columns if name in stored.columns])
    encoder = fit_encoder(full)
    split = encoder.transform(stratified_split(full, KEY, LABEL))
    rows = materialize(split, "split", partition_by="split")
    train = rows.filter(c("split") == "train")
    # Two rows.
    classes = {row["label"]: row for row in class_weights(train, LABEL).collect()}
    if set(classes) != {0, 1}:
        raise ValueError("training rows of both classes are needed")
    return Prepared(
        rows=rows,
        encoder=encoder,
        scaler=fit_scaler(train, columns),
        features=tuple(columns),
        class_counts={label: row["n"] for label, row in classes.items()},
        class_weight={label: row["balanced_weight"] for label, row in classes.items()},
        imbalance=classes[0]["scale_pos_weight"],
        filled=filled,
    )


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """``n`` stored rows in no more partitions than cores, or than ``FIT_ROWS`` rows each make.

    A fit passes over its rows some hundred times. In each pass every partition is a task that
    answers the driver, and for trees one more set of all nodes' sums to send and merge.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(cores, math.ceil(n / FIT_ROWS)))


def fit_logistic(data: Prepared) -> Transformer:
    """L2 logistic regression. Balanced weights sum to the row count, hence the penalty."""
    n = sum(data.class_counts.values())
    return LogisticRegression(
        labelCol="label",
        weightCol="balanced",
        maxIter=LOGISTIC_ITERATIONS,
        regParam=1.0 / (INVERSE_REGULARIZATION * n),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-7,
    ).fit(data.fit_rows)


def fit_forest(data: Prepared) -> Transformer:
    """Random forest. Leaves of 50 rows imply that no node under 100 rows is split.

    Keeping each row's node per tree (spilling to disk, checkpointed) spares every pass over a
    deep level the walk from all roots.
    """
    return RandomForestClassifier(
        labelCol="label",
        weightCol="balanced",
        featureSubsetStrategy="sqrt",
        seed=SEED,
        maxMemoryInMB=TREE_BUFFER_MB,
        cacheNodeIds=True,
        **FOREST,
    ).fit(data.fit_rows)


def best_round(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Rounds up to the best loss seen before ``patience`` rounds passed without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model's first ``n`` trees, cut from its stored form.

    Each tree is fitted to what the earlier ones left over, so the first trees of a long ensemble
    are those of a short one. A stored ensemble is a table of nodes, a table of trees, and their
    number in one line of text.
    """
    spark = SparkSession.getActiveSession()
    whole, cut = fresh_path(spark, "boosting"), fresh_path(spark, "boosting-cut")
    model.write().save(whole)
    spark.read.parquet(f"{whole}/data").filter(c("treeID") < n).write.parquet(f"{cut}/data")
    trees = spark.read.parquet(f"{whole}/treesMetadata")
    trees.filter(c(trees.columns[0]) < n).write.parquet(f"{cut}/treesMetadata")
    line = json.loads(spark.read.text(f"{whole}/metadata").first()[0]) | {"numTrees": n}
    spark.createDataFrame([(json.dumps(line),)], "value STRING").coalesce(1).write.text(f"{cut}/metadata")
    return GBTClassificationModel.load(cut)


def fit_boosting(data: Prepared) -> Transformer:
    """Boosted trees, cut at the best validation loss.

    The built-in validation rule is a tolerance, not a patience, so the losses are read off the
    fitted ensemble, and it is cut to the kept rounds. A short ensemble is fitted first: its trees
    and losses are the first of the long one's. All rounds follow only if the patience outlasts it.
    """
    unweighted = data.part("val").withColumn("positive", F.lit(1.0))
    for most in (min(FIRST_ROUNDS, BOOSTING["maxIter"]), BOOSTING["maxIter"]):
        trainer = GBTClassifier(
            labelCol="label",
            weightCol="positive",
            featureSubsetStrategy=BOOSTING_COLUMN_SHARE,
            seed=SEED,
            maxMemoryInMB=TREE_BUFFER_MB,
            **BOOSTING | {"maxIter": most},
        )
        model = trainer.fit(data.fit_rows)
        losses = list(model.evaluateEachIteration(unweighted))
        rounds = best_round(losses)
        if len(losses) - rounds >= PATIENCE:
            break
    return model if rounds == len(losses) else first_trees(model, rounds)


TRAINERS = {
    "logistic_regression": fit_logistic,
    "random_forest": fit_forest,
    "gradient_boosting": fit_boosting,
}


def score(model: Transformer, rows: DataFrame, name: str, *keep: str) -> DataFrame:
    """Label, probability of class 1 and decision for each row."""
    return model.transform(rows).select(
        F.lit(name).alias("model"),
        *keep,
        c("label").cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        c("prediction").cast("int").alias("prediction"),
    )


@dataclass
class Training:
    """Prepared data and its models; a model is trained when first asked for."""

    data: Prepared
    _models: dict[str, Transformer] = field(default_factory=dict)
    _best: str | None = None

    def model(self, name: str) -> Transformer:
        if name not in self._models:
            self._models[name] = TRAINERS[name](self.data)
        return self._models[name]

    def scored(self, name: str, part: str) -> DataFrame:
        return score(self.model(name), self.data.part(part), name, KEY)

    def all_scored(self, part: str) -> DataFrame:
        stacked = self.scored(MODEL_ORDER[0], part)
        for name in MODEL_ORDER[1:]:
            stacked = stacked.unionByName(self.scored(name, part))
        return stacked

    def comparison(self, part: str = "val") -> DataFrame:
        """The six metrics of every model, rounded to 4 places."""
        table = metrics.summary(self.all_scored(part))
        return table.select("model", *[F.round(name, 4).alias(name) for name in table.columns[1:]])

    def best(self, metric: str = "auc_roc") -> DataFrame:
        """The model with the highest metric; the first one trained wins a tie."""
        table = metrics.summary(self.all_scored("val"))
        order = F.array_position(F.array(*[F.lit(name) for name in MODEL_ORDER]), c("model"))
        return table.orderBy(F.desc(metric), order).limit(1).select("model", metric)

    def best_name(self) -> str:
        if self._best is None:
            self._best = self.best().first()["model"]
        return self._best

    def test_evaluation(self, name: str | None = None) -> DataFrame:
        """Metrics and classification report of one model on the held-out rows, long form."""
        name = name or self.best_name()
        held_out = self.scored(name, "test")
        headline = metrics.summary(held_out)
        figures = headline.unpivot(["model"], headline.columns[1:], "metric", "value")
        report = metrics.classification_report(held_out, ["model"])
        kinds = ["precision", "recall", "f1", "support"]
        lines = (
            report.withColumn("support", c("support").cast("double"))
            .unpivot(["model", "class_name"], kinds, "kind", "value")
            .select("model", F.concat_ws(" ", "class_name", "kind").alias("metric"), "value")
        )
        return figures.unionByName(lines)

    def full_model(self, name: str) -> PipelineModel:
        """Encoder, scaler, assembler and classifier: scores rows of the wide table."""
        return PipelineModel([*self.data.stages, self.model(name)])


def _count(rows: DataFrame, model: str, **checks: Column) -> DataFrame:
    """``model, name, n``: rows for which each check holds, in one pass."""
    wide = rows.agg(*[F.count_if(check).alias(name) for name, check in checks.items()])
    return wide.unpivot([], list(checks), "name", "n").select(F.lit(model).alias("model"), "name", "n")


def gradient_size(model: LogisticRegressionModel, data: Prepared) -> float:
    """Length of the penalised loss's gradient at the fitted weights; near zero at the optimum."""
    n = sum(data.class_counts.values())
    rows = model.transform(data.part("train"))
    error = (vector_to_array("probability")[1] - c("label")) * c("balanced")
    x = rows.select(error.alias("error"), "balanced", vector_to_array("features").alias("x"))
    sums = x.agg(
        F.sum("balanced"), F.sum("error"),
        *[F.sum(c("error") * c("x")[i]) for i in range(len(data.features))],
    ).first()
    slopes = [part / sums[0] for part in sums[1:]]
    penalty = 1.0 / (INVERSE_REGULARIZATION * n)
    slopes[1:] = [g + penalty * w for g, w in zip(slopes[1:], model.coefficients.toArray())]
    return sum(g * g for g in slopes) ** 0.5


def model_checks(models: Training, path: str, tolerance: float = 1e-6) -> DataFrame:
    """``model, name, n``: how many rows of each model keep what must hold of any fitted model.

    Rows and positives per split, scores between 0 and 1, decisions at one half, equal scores after
    saving and loading below ``path``; for the linear model also attributions that add up to the
    difference of the logits, and whether its gradient vanishes.
    """
    found = []
    for name in MODEL_ORDER:
        for part in ("val", "test"):
            scored = models.scored(name, part)
            found.append(
                _count(
                    scored, name,
                    **{
                        f"{part}_rows": F.lit(True),
                        f"{part}_positives": c("label") == 1,
                        f"{part}_bounded": c("score").between(0.0, 1.0),
                        f"{part}_decided": c("prediction") == F.when(c("score") > 0.5, 1).otherwise(0),
                    },
                )
            )
        encoded = [f"{column}_encoded" for column in CATEGORICAL]
        wide = models.data.rows.filter(c("split") == "test").drop(*encoded).withColumn("label", c(LABEL))
        saved = f"{path}-{name}"
        models.full_model(name).write().save(saved)
        again = score(PipelineModel.load(saved), wide, name, KEY).select(KEY, c("score").alias("again"))
        both = models.scored(name, "test").join(again, KEY)
        found.append(_count(both, name, test_reloaded=F.abs(c("score") - c("again")) <= tolerance))
    linear, test = models.model("logistic_regression"), models.data.part("test")
    parts = linear_attribution(linear, test, models.data.features).groupBy(KEY).agg(F.sum("attribution").alias("total"))
    logits = models.scored("logistic_regression", "test").select(
        KEY, F.log(c("score") / (F.lit(1.0) - c("score"))).alias("logit")
    )
    # The logit at the mean row is the mean of the logits.
    middle = logits.agg(F.avg("logit").alias("middle"))
    apart = parts.join(logits, KEY).withColumn("middle", middle.scalar())
    found.append(
        _count(apart, "logistic_regression", test_attributed=F.abs(c("total") - (c("logit") - c("middle"))) <= tolerance)
    )
    flat = gradient_size(linear, models.data) <= 1e-3
    spark = test.sparkSession
    found.append(spark.range(1).select(F.lit("logistic_regression").alias("model"), F.lit("gradient_vanishes").alias("name"), F.lit(int(flat)).cast("bigint").alias("n")))
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def feature_importance(
    spark, model: Transformer, features: Sequence[str], kind: str, top: int = 15
) -> DataFrame:
    """Features by tree importance or by coefficient size: one row per feature."""
    if kind in ("random_forest", "gradient_boosting"):
        values = model.featureImportances.toArray()
    elif kind == "logistic_regression":
        values = abs(model.coefficients.toArray())
    else:
        raise ValueError(f"unknown model type: {kind}")
    rows = [(name, float(value)) for name, value in zip(features, values)]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def linear_attribution(
    model: LogisticRegressionModel, rows: DataFrame, features: Sequence[str], n: int | None = None
) -> DataFrame:
    """Exact per-row attribution of a linear model: weight times distance from the mean.

    Over all rows, or over a reproducible sample of ``n`` rows if asked for; the mean of the
    rows explained is the reference point. One aggregate gives the means, one number per
    feature; the rest is a projection.
    """
    sample = rows.select(KEY, vector_to_array("features").alias("x"))
    if n is not None:
        sample = hashed_sample(sample, KEY, n)
    found = sample.agg(*[F.avg(c("x")[i]).alias(f"mean_{i}") for i in range(len(features))]).first()
    means = [value or 0.0 for value in found]
    weights = model.coefficients.toArray()
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                c("x")[i].alias("value"),
                (F.lit(float(weights[i])) * (c("x")[i] - F.lit(means[i]))).alias("attribution"),
            )
            for i, name in enumerate(features)
        ]
    )
    return sample.select(KEY, F.inline(parts))


def permutation_importance(
    model: Transformer, rows: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Drop in ROC area when one feature's values are dealt out to other rows.

    Rows are numbered in hash order and each takes the value of its successor, so every value
    is used exactly once. One join pairs the rows; the untouched rows and one variant per
    feature are then scored and measured together.
    """
    ranked = hashed_rank(rows.select(KEY, "label", vector_to_array("features").alias("x")), KEY)
    donors = ranked.select(
        (c("rank") % c("size") + F.lit(1)).alias("rank"), c("x").alias("other")
    )
    untouched = ""
    variants = F.posexplode(F.array(*[F.lit(name) for name in (*features, untouched)]))
    swapped = F.transform("x", lambda x, i: F.when(i == c("at"), c("other")[i]).otherwise(x))
    shuffled = (
        ranked.join(donors, "rank")
        .select("label", "x", "other", variants.alias("at", "feature"))
        .select("label", "feature", array_to_vector(swapped).alias("features"))
    )
    areas = metrics.auc_roc(score(model, shuffled, "shuffled", "feature"), ["feature"])
    # One row per feature.
    all_rows = W.partitionBy()
    before = F.max(F.when(c("feature") == untouched, c("auc_roc"))).over(all_rows)
    return (
        areas.select("feature", before.alias("auc_roc"), c("auc_roc").alias("auc_roc_shuffled"))
        .filter(c("feature") != untouched)
        .withColumn("importance", c("auc_roc") - c("auc_roc_shuffled"))
        .orderBy(F.desc("importance"), "feature")
    )
