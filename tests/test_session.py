"""Where written intermediates go."""

import os
from types import SimpleNamespace

import pytest

from holdfast.__main__ import run
from holdfast.session import materialize, run_folder, shared_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=Context(master))


def test_the_cluster_names_the_folder():
    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:/shared"})) == "hdfs:/shared"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))


def test_a_cluster_on_one_machine_is_refused_too():
    with pytest.raises(RuntimeError):
        shared_dir(session("local-cluster[2,1,1024]"))


def test_a_run_leaves_nothing_behind(spark, small_dir, tmp_path):
    before = sorted(os.listdir(shared_dir(spark)))
    run(spark, small_dir, str(tmp_path), ["score_store_roundtrip", "standard_scale", "csv_roundtrip"])
    assert sorted(os.listdir(shared_dir(spark))) == before
    assert sorted(os.listdir(tmp_path)) == ["csv_roundtrip", "score_store_roundtrip", "standard_scale"]
    with run_folder(spark) as folder:
        materialize(spark.range(3), "probe")
        assert os.listdir(folder)
    assert not os.path.exists(folder)


def test_a_local_session_keeps_its_scratch_folder():
    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_materialized_rows_come_back_from_the_folder(spark):
    df = spark.range(10).selectExpr("id", "id % 2 AS part", "CAST(NULL AS STRING) AS nothing")
    table = materialize(df, "probe", partition_by="part")
    assert sorted(table.columns) == sorted(df.columns)
    assert table.select(df.columns).exceptAll(df).count() == 0 and table.count() == 10
    assert all(shared_dir(spark) in path for path in table.inputFiles())
