"""Classifier metrics from labelled scores, exact under ties and independent of any model.

Input rows carry ``label`` (0/1), ``score`` and ``prediction`` (0/1); ``by`` names columns that
tell several models apart and are evaluated side by side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.features import flag, ratio
from holdfast.operators.ordering import covers, per_value, running_totals

c = F.col

# Names of the two classes.
CLASS_NAMES = {0: "Retained", 1: "Churned"}


def score_steps(
    scored: DataFrame, by: Sequence[str] = (), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct score, highest first, with running and total class counts.

    ``extra`` sums are carried along without running totals.
    """
    sums = {
        "pos": c("label").cast("bigint"),
        "neg": (F.lit(1) - c("label")).cast("bigint"),
        **(extra or {}),
    }
    steps = per_value(scored, "score", sums, by)
    return running_totals(steps, "score", ["pos", "neg"], by, descending=True)


def _with_end_point(point: Column, end: Column) -> Column:
    """Rows of a curve: each step's point, and before the highest score's the ``end``."""
    is_first = (c("cum_pos") == c("pos")) & (c("cum_neg") == c("neg"))
    return F.inline(F.when(is_first, F.array(end, point)).otherwise(F.array(point)))


def _no_threshold() -> Column:
    return F.lit(None).cast("double").alias("threshold")


def roc_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every ROC point, from the origin (no threshold) to (1, 1)."""
    point = F.struct(
        c("score").alias("threshold"),
        ratio(c("cum_neg"), c("total_neg")).alias("fpr"),
        ratio(c("cum_pos"), c("total_pos")).alias("tpr"),
    )
    origin = F.struct(_no_threshold(), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return score_steps(scored, by).select(*by, _with_end_point(point, origin))


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every precision-recall point and the end point (1, 0), with the base rate."""
    base = ratio(c("total_pos"), c("total_pos") + c("total_neg")).alias("baseline")
    point = F.struct(
        c("score").alias("threshold"),
        ratio(c("cum_pos"), c("cum_pos") + c("cum_neg")).alias("precision"),
        ratio(c("cum_pos"), c("total_pos")).alias("recall"),
        base,
    )
    end = F.struct(_no_threshold(), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), base)
    return score_steps(scored, by).select(*by, _with_end_point(point, end))


def _area() -> Column:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    half_tied = c("cum_pos") - c("pos") / F.lit(2.0)
    # As DOUBLE: the product of two counts soon leaves BIGINT.
    return ratio(F.sum(c("neg") * half_tied), F.max("total_pos").cast("double") * F.max("total_neg"))


def _average_precision() -> Column:
    precision = c("cum_pos") / (c("cum_pos") + c("cum_neg"))
    return ratio(F.sum(c("pos") * precision), F.max("total_pos"))


def auc_roc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score_steps(scored, by).groupBy(*by).agg(_area().alias("auc_roc"))


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score_steps(scored, by).groupBy(*by).agg(_average_precision().alias("average_precision"))


def _top_share(share: float) -> list[Column]:
    """Threshold at the upper ``share`` of the scores, and what lies at or above it.

    The threshold is interpolated between two neighbouring scores. A score reaches it exactly
    if it is at least the upper neighbour, so the running counts there are the answer.
    """
    n = c("pos") + c("neg")
    total = c("total_pos") + c("total_neg")
    # Positions count upwards, the running totals downwards.
    up_to = total - (c("cum_pos") + c("cum_neg")) + n
    position = F.lit(1.0 - share) * (total - F.lit(1))
    lower = covers(F.floor(position), up_to, n)
    upper = covers(F.ceil(position), up_to, n)
    return [
        F.max(F.when(lower, c("score"))).alias("lo"),
        F.max(F.when(upper, c("score"))).alias("hi"),
        F.max(position - F.floor(position)).alias("part"),
        F.max(F.when(upper, c("cum_pos") + c("cum_neg"))).alias("n_selected"),
        F.max(F.when(upper, c("cum_pos"))).alias("n_hits"),
    ]


def precision_at_top(scored: DataFrame, share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Precision among the scores at or above the ``1 - share`` quantile, all ties kept."""
    return (
        score_steps(scored, by)
        .groupBy(*by)
        .agg(*_top_share(share))
        .select(
            *by,
            (c("lo") + (c("hi") - c("lo")) * c("part")).alias("threshold"),
            "n_selected",
            ratio(c("n_hits"), c("n_selected")).alias("precision_at_10pct"),
        )
    )


def confusion_matrix(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count of every (label, prediction) pair, absent pairs included."""
    cells = [(label, guess) for label in (0, 1) for guess in (0, 1)]
    wide = scored.groupBy(*by).agg(
        *[
            F.count_if((c("label") == label) & (c("prediction") == guess)).alias(f"n{label}{guess}")
            for label, guess in cells
        ]
    )
    tall = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(guess).alias("prediction"),
                c(f"n{label}{guess}").alias("n"),
            )
            for label, guess in cells
        ]
    )
    return wide.select(*by, F.inline(tall))


def _or_zero(value: Column) -> Column:
    """A rate without cases is reported as 0."""
    return F.coalesce(value, F.lit(0.0))


def _class_rates(hits: Column, guessed: Column, actual: Column) -> tuple[Column, Column, Column]:
    precision = _or_zero(ratio(hits, guessed))
    recall = _or_zero(ratio(hits, actual))
    f1 = _or_zero(ratio(F.lit(2) * hits, guessed + actual))
    return precision, recall, f1


def _decisions() -> dict[str, Column]:
    """0/1 columns whose sums are right, predicted and actual rows of each class."""
    columns = {}
    for k in CLASS_NAMES:
        actual, guessed = c("label") == k, c("prediction") == k
        columns[f"hits{k}"] = flag(actual & guessed)
        columns[f"guessed{k}"] = flag(guessed)
        columns[f"actual{k}"] = flag(actual)
    return columns


def classification_report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rates, accuracy, and plain and support-weighted means, one row each."""
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(column).alias(name) for name, column in _decisions().items()],
    )
    rates = {
        k: _class_rates(c(f"hits{k}"), c(f"guessed{k}"), c(f"actual{k}")) for k in CLASS_NAMES
    }
    measured = counts.select(
        *by,
        "n",
        *[c(f"actual{k}") for k in CLASS_NAMES],
        ratio(c("hits0") + c("hits1"), c("n")).alias("accuracy"),
        *[
            rates[k][i].alias(f"{name}{k}")
            for k in CLASS_NAMES
            for i, name in enumerate(("precision", "recall", "f1"))
        ],
    )

    def row(name: str, values: Sequence[Column], support: Column) -> Column:
        columns = zip(("precision", "recall", "f1"), values)
        return F.struct(
            F.lit(name).alias("class_name"),
            *[value.alias(column) for column, value in columns],
            support.alias("support"),
        )

    kinds = ("precision", "recall", "f1")
    plain = [(c(f"{kind}0") + c(f"{kind}1")) / F.lit(2.0) for kind in kinds]
    weighted = [
        ratio(c(f"{kind}0") * c("actual0") + c(f"{kind}1") * c("actual1"), c("n")) for kind in kinds
    ]
    lines = [row(name, [c(f"{kind}{k}") for kind in kinds], c(f"actual{k}")) for k, name in CLASS_NAMES.items()]
    lines.append(row("accuracy", [c("accuracy")] * 3, c("n")))
    lines.append(row("macro avg", plain, c("n")))
    lines.append(row("weighted avg", weighted, c("n")))
    return measured.select(*by, F.inline(F.array(*lines)))


def summary(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The six headline metrics, one row per ``by`` group, from one pass over the scores."""
    kept = {name: column for name, column in _decisions().items() if name.endswith("1")}
    precision, recall, f1 = _class_rates(c("hits1"), c("guessed1"), c("actual1"))
    return (
        score_steps(scored, by, kept)
        .groupBy(*by)
        .agg(
            _area().alias("auc_roc"),
            _average_precision().alias("auc_pr"),
            *_top_share(0.1),
            *[F.sum(name).alias(name) for name in kept],
        )
        .select(
            *by,
            "auc_roc",
            "auc_pr",
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            _or_zero(ratio(c("n_hits"), c("n_selected"))).alias("precision_at_10pct"),
        )
    )
