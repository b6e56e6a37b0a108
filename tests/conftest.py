import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdfast.session import build_session

DATA = "/root/testdata"
TABLES = ("customer", "events", "lineitem")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium_dir():
    return f"{DATA}/sf0.01"


def duck(folder):
    """DuckDB connection with the folder's tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def skewed_dir(tmp_path_factory, small_dir):
    """The small tables with two fifths of the events on one user and half the scores equal."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duck(small_dir)
    con.sql(
        "COPY (SELECT * REPLACE (CASE WHEN event_id % 5 < 2 THEN 3 ELSE user_id END AS user_id)"
        f" FROM events) TO '{folder}/events.parquet'"
    )
    con.sql(
        "COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN 0.05 ELSE l_discount END AS l_discount,"
        " CASE WHEN l_orderkey % 2 = 0 THEN 20.0 ELSE l_quantity END AS l_quantity)"
        f" FROM lineitem) TO '{folder}/lineitem.parquet'"
    )
    con.sql(f"COPY customer TO '{folder}/customer.parquet'")
    return str(folder)
