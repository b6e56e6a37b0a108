"""CSV files, the daily score store, and saved models."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition; an unknown value is an empty cell."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema: no inference pass over the files."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Store scoring runs, one folder per scoring day. Rerunning a day replaces only that day.

    The rebalance hint lets adaptive execution cut a large day into several even files and put
    a small one into a single file.
    """
    (
        scores.withColumn("score_date", F.to_date("scored_at"))
        .hint("rebalance", F.col("score_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("score_date")
        .parquet(path)
    )


# Columns of a stored score row.
SCORE_SCHEMA = (
    "user_id BIGINT, churn_probability DOUBLE, risk_tier STRING, days_since_login INT,"
    " trade_freq_trend DOUBLE, engagement_score INT, trades_30d BIGINT, yield_adoption INT,"
    " n_assets INT, portfolio_value DOUBLE, scored_at TIMESTAMP_NTZ, score_date DATE"
)


def read_scores(
    spark: SparkSession, path: str, since: date | None = None, schema: str = SCORE_SCHEMA
) -> DataFrame:
    """Stored scores; ``since`` prunes folders before any file is opened.

    The schema is given: no file is opened for it, and a store without a run is empty.
    """
    scores = spark.read.schema(schema).parquet(path)
    if since is None:
        return scores
    return scores.filter(F.col("score_date") >= F.lit(since))


def write_day(rows: DataFrame, path: str, day: date) -> None:
    """Store one day's rows in the day's folder; running the day again replaces that folder."""
    (
        rows.withColumn("day", F.lit(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Store rows of many days, a folder each."""
    (
        rows.withColumnRenamed(day, "day")
        .hint("rebalance", F.col("day"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, schema: str, days: Sequence[date]) -> DataFrame:
    """The rows of some days; other folders are not opened, and a day without one has no rows."""
    return spark.read.schema(schema).parquet(path).filter(F.col("day").isin(*days))


def write_bucketed(rows: DataFrame, table: str, path: str, key: str, buckets: int, day: str | None = None) -> DataFrame:
    """A table dealt into files by ``key``, in folders by ``day`` if there is one.

    Tables with the same number of buckets join and aggregate on the key without a shuffle. Each
    bucket is one file of a day's folder.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").option("path", path)
    if day is not None:
        writer = writer.partitionBy(day)
    writer.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
