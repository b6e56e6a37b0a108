"""Exact stratified splits and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from holdfast.functions.features import ratio
from holdfast.operators.ordering import hashed_rank

c = F.col


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, val_share: float = 0.1
) -> DataFrame:
    """Add ``split``: train, val or test, with the exact share of each class in each part.

    Two stages, as usual: the test rows are cut off each class first, the validation rows then
    take their share of what is left. Rows are drawn by key hash, so the split is the same on
    every run and in every partitioning. Rows without a label are split like a class.
    """
    ranked = hashed_rank(df, key, by=[label])
    n_test = F.round(c("size") * F.lit(test_share))
    n_val = F.round((c("size") - n_test) * F.lit(val_share / (1.0 - test_share)))
    return ranked.withColumn(
        "split",
        F.when(c("rank") <= n_test, "test").when(c("rank") <= n_test + n_val, "val").otherwise("train"),
    ).drop("rank", "size")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: row count, balanced weight n / (2 n_c), and the ratio of zeros to ones."""
    rows = df.filter(c(label).isin(0, 1))
    # One row per class, so the window over all of them holds two.
    counts = rows.groupBy(c(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    both = W.partitionBy()
    total = F.sum("n").over(both)
    zeros = F.sum(F.when(c("label") == 0, c("n"))).over(both)
    ones = F.sum(F.when(c("label") == 1, c("n"))).over(both)
    return counts.select(
        "label",
        "n",
        ratio(total, F.lit(2) * c("n")).alias("balanced_weight"),
        ratio(zeros, ones).alias("scale_pos_weight"),
    )
