"""The catalogue against the same SQL in DuckDB, and the driver's contract."""

import importlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool | str):
        return str(x)
    try:
        return f"{float(x):.4f}"
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck):
    got = QUERIES[name](spark, FOLDER)
    assert name in ORACLE
    expected = duck.sql(ORACLE[name])
    columns = expected.columns
    assert sorted(got.columns) == sorted(columns)
    ours = sorted(tuple(_cell(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(_cell(x) for x in r) for r in expected.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_engine_does_not_need_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "_present", lambda *names: False)
    assert set(entry.queries()) == set(QUERIES)
    assert importlib.util.find_spec("millrace") is not None


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["select_sift"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan
    assert "l_shipdate" not in plan


@pytest.mark.parametrize("backwards", [False, True])
def test_above_the_mean_whatever_the_order(spark, tmp_path, backwards):
    users = {
        1: [0.1, 0.2, 0.3],
        2: [49.67] * 60,
        3: [1.01, None, 1.03, 1.02],
        4: [1e300, 0.0],
        5: [math.nan, 1.0],
        6: [-0.2, -0.1, -0.3],
        7: [None],
        8: [1e-30, 3e-30],
    }
    rows = [(1000 * u + i, u, v) for u, values in users.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows[::-1] if backwards else rows, "event_id long, user_id long, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    above = {r.event_id: r.above for r in QUERIES["win_mutate"](spark, str(tmp_path)).collect()}
    got = {u: [above.pop(1000 * u + i) for i in range(len(values))] for u, values in users.items()}
    assert not above
    assert got == {
        1: [False, False, True],
        2: [False] * 60,
        3: [False, None, True, False],
        4: [True, False],
        5: [True, True],
        6: [False, True, False],
        7: [None],
        8: [False, True],
    }
