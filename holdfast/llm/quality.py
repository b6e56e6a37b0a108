"""Text quality by a sparse rule ensemble.

A shallow random forest over text statistics proposes rules: the path to each of its nodes is a
conjunction of comparisons. A lasso logistic regression over the rules' truth values keeps few of
them, and these are compiled into one Spark column expression that scores every document.

The statistics of all documents come from one scan and are written once; learning uses at most
``TRAIN_ROWS`` labelled rows, chosen by hash of the id.

Defined results: a null text is empty; an empty text has the statistics of zero words and the
score that the rules give those; texts are read whole; repeated rows and null ids are scored like
others; without labelled rows the score is 0.5, with labels of one class it is that class; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.tables import WORD, stored, whole_text

TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.001
HELD_OUT, FOLDS = 1, 3
SEED = 11

c = F.col


def statistics(text: Column) -> Column:
    """A struct of statistics of the whole text; shares are per word unless they say otherwise."""

    def of(words: Column) -> Column:
        n = F.size(words).cast("double")
        per_word = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(n, F.lit(1.0))
        again = F.size(F.filter(F.transform(words, lambda x, i: x == F.get(words, i - 1)), lambda x: x))
        return F.struct(
            F.log1p(n).alias("log_words"),
            (F.length(text) / F.greatest(n, F.lit(1.0))).alias("chars"),
            (F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1.0))).alias("distinct"),
            (again / F.greatest(n, F.lit(1.0))).alias("again"),
            F.coalesce(F.array_max(F.transform(words, lambda x: F.length(x))), F.lit(0)).cast("double").alias("longest"),
            per_word(r"\p{Lu}{2,}").alias("shouted"),
            per_word(r"\p{Lu}").alias("capitals"),
            per_word(r"[^\p{L}\p{N}\s.,;:'\"()\-]").alias("symbols"),
            per_word(r"\p{N}+").alias("numbers"),
            per_word(r"[.!?](?:\s|$)").alias("sentences"),
            per_word(r"[.,;:]").alias("stops"),
            per_word(r"\n").alias("lines"),
            per_word(r"(?<![^\s])[^\p{L}\p{N}\s]+(?![^\s])").alias("bare_marks"),
            per_word(r"https?://|www\.|@").alias("links"),
        )

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), of)[0]


NAMES = ("log_words", "chars", "distinct", "again", "longest", "shouted", "capitals", "symbols", "numbers",
         "sentences", "stops", "lines", "bare_marks", "links")


@dataclass(frozen=True)
class Rule:
    """All of its comparisons (statistic, is it above, bound) hold."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, bound in self.parts:
            held = held & (c(name) > F.lit(bound) if above else c(name) <= F.lit(bound))
        return held.cast("double")


def rules_of(printed: str, names=NAMES) -> list[Rule]:
    """The path to each node of the trees in a model's printed form."""
    step = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
    path: dict[int, tuple[str, bool, float]] = {}
    rules: set[Rule] = set()
    for line in printed.splitlines():
        if line.strip().startswith("Tree "):
            path.clear()
        found = step.match(line)
        if found:
            depth = len(found[1])
            path = {d: p for d, p in path.items() if d < depth}
            path[depth] = (names[int(found[3])], found[4] == ">", float(found[5]))
            rules.add(Rule(tuple(sorted(path.values()))))
    return sorted(rules, key=lambda rule: rule.parts)


def held_out(id_col: str = "doc_id", fold: int = HELD_OUT, folds: int = FOLDS) -> Column:
    """Whether the fold of a row, by CRC-32 of its id as text, is the one kept from learning."""
    return F.coalesce(F.crc32(c(id_col).cast("string")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, label: str, kept_out: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label``: at most ``most`` labelled ids outside the held-out fold, by hash."""
    known = labels.where(c("doc_id").isNotNull() & c(label).isNotNull() & ~kept_out)
    one = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_rules(rows: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows with the statistics and ``label``."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        # Nothing to tell apart: a score of (nearly) the only class, or 0.5 without labels.
        return (0.0 if not counts else 30.0 if 1.0 in counts else -30.0), []
    vectors = rows.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, seed=SEED).fit(vectors)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return math.log(counts[1.0] / counts[0.0]), []
    truth = rows.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(truth)
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as one column expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.lit(weight) * rule.column()
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document."""
    measured = docs.select(c(id_col).alias("doc_id"), statistics(whole_text(text_col)).alias("s"))
    table = stored(measured.select("doc_id", "s.*"), "quality-statistics")
    known = training_labels(labels, label, held_out())
    # One row of each id, so that repeated ones don't exceed the bound.
    learned = table.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *NAMES)).alias("row"))
    rows = stored(learned.select("doc_id", "row.*"), "quality-training")
    score = compiled(*fit_rules(rows))
    return table.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (c("score") >= threshold).cast("int")
    )
