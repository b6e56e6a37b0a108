"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUN_DIR = "holdfast.run.dir"


def build_session(name: str = "holdfast", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the jobs expect.

    Joins carry no hints: adaptive execution picks broadcast only for a side whose measured
    size is under the threshold, and splits skewed shuffle partitions otherwise.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session may run without it; it then gets a scratch folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="holdfast-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the folder of the run, or else the shared folder."""
    folder = spark.conf.get(RUN_DIR, None) or shared_dir(spark)
    return os.path.join(folder, f"{label}-{uuid.uuid4().hex}")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediates of a run, removed at its end.

    Results that read from it must be written elsewhere before that.
    """
    folder = os.path.join(shared_dir(spark), f"run-{uuid.uuid4().hex}")
    spark.conf.set(RUN_DIR, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(RUN_DIR)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the table.

    Cuts the lineage: work after it restarts from files, not from the sources, when an
    executor is lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
