"""Every query with a SQL counterpart gives its rows, names and types."""

import math

import pytest

import __spark_entry__ as contract
from oracles.sql import oracle_sql
from tests.conftest import duck

ORACLES = oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}
# Keys whose work hangs on the event or score distribution.
SKEWED = (
    "churn_daily_scoring", "activity_features", "portfolio_return_lag30", "high_risk_targeting",
    "cohort_retention", "model_calibration", "profile_describe", "boxplot_by_class",
    "roc_curve", "pr_curve", "auc_roc", "average_precision", "precision_at_top_decile",
    "contact_reach", "contacted_users_trailing", "signup_contacts", "activity_windows_daily",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def sort_key(row):
    return tuple((value is None, str(value)) for value in row)


def compare(spark, folder, name):
    result = contract.queries()[name](spark, folder)
    expected = duck(folder).sql(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(result.columns) == columns
    want_types = dict(zip(expected.columns, map(str, expected.types)))
    assert {n: TYPES[t] for n, t in result.dtypes} == want_types
    at = {n: i for i, n in enumerate(expected.columns)}
    got = sorted((tuple(plain(row[n]) for n in columns) for row in result.collect()), key=sort_key)
    want = sorted(
        (tuple(plain(row[at[n]]) for n in columns) for row in expected.fetchall()), key=sort_key
    )
    assert len(want) > 0
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small_dir, name):
    compare(spark, small_dir, name)


@pytest.mark.parametrize("name", SKEWED)
def test_matches_sql_under_skew(spark, skewed_dir, name):
    compare(spark, skewed_dir, name)


def test_entry_orders_by_risk(spark):
    rows = contract.entry(spark).collect()
    known = [row.churn_probability for row in rows if row.churn_probability is not None]
    assert known == sorted(known, reverse=True)
    assert all(row.churn_probability is None for row in rows[len(known):])
