import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DATA = "/root/testdata"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("size", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("copies", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("_row", T.StringType()),
    ]
)


def awkward_rows():
    """Null, empty, very long, tied and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 31}." for i in range(30_000))
    plain = "The river that ran past the old mill was slow and brown in late summer days."
    texts = [
        (1, plain, "a"),
        (2, plain, "a"),
        (3, plain.upper(), "b"),
        (4, None, None),
        (5, "", "b"),
        (6, " \t\n ", None),
        (7, long, "a"),
        (8, long + " tail", "c"),
        (9, "é" * 300 + " ünï cödé \U0001f600 text\x00with zero", "c"),
        (9, "same id, other text here", "c"),
        (None, "no id here at all", "a"),
        (None, None, None),
        (10, "one", "c"),
        (10, "one", "c"),
        (11, plain + " " + plain, ""),
        (12, "<|endoftext|> <|endoftext|>  two  spaces \n and\ttabs ", ""),
        (13, "x" * 5000, "d"),
    ]
    return [
        Row(i, t, "en" if s else None, s, None if t is None else len(t), "size", None, "s", "c", "l", "r")
        for i, t, s in texts
    ]


VECTOR_SCHEMA = (
    "vec_id long, embedding array<float>, label int, vector string, row string, cell long, norm2 string, rank int,"
    " score string, least string"
)


def awkward_vectors():
    """Null, empty, short, equal, opposed, non-finite vectors; repeated and null ids; a hot one."""
    draw = random.Random(7)
    point = lambda n=6: [draw.uniform(-1, 1) for _ in range(n)]
    same = point()
    rows = [(i, point(), i % 3) for i in range(0, 500, 10)]
    rows += [(i, same, i % 2) for i in range(1, 400, 4)]
    rows += [(600, same, 1), (600, same, 1), (600, [-x for x in same], 1), (700, point(), None), (None, same, 0), (None, None, None)]
    rows += [(800, None, 1), (900, [], 2), (1000, [0.0] * 6, 2), (1100, point(3), 0), (1200, point(9), 1)]
    rows += [(1300, [0.5, None, 0.1], 0), (1400, [float("nan")] * 6, 0), (1500, [0.1, float("inf")], 1), (1600, [-0.0] * 3, 1)]
    rows += [(-100, [30.0] * 6, 0), (-50, [-30.0] * 6, 1), (-200, same, 0)]
    return [(i, v, label, "v", "r", 1, "n", 1, "s", "l") for i, v, label in rows]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """The folder of a small table of awkward documents, and labels for some."""
    folder = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(awkward_rows(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i == 3)) for i in range(1, 12)] + [(None, 1, 1), (4, None, None), (4, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(awkward_vectors(), VECTOR_SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def nothing(spark, awkward, tmp_path_factory):
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("nothing")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(folder, columns="doc_id, text, source"):
    path = f"{folder}/documents.parquet"
    import os

    path = f"{path}/*.parquet" if os.path.isdir(path) else path
    return duckdb.sql(f"SELECT {columns} FROM '{path}'").fetchall()


def key(row):
    return tuple((x is None, str(x)) for x in row)
