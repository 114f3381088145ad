"""Every rule query against its SQL in DuckDB."""

import importlib
import math
import sys

import duckdb
import pytest

from tidewatch import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_rows(spark, con, name):
    df, sql = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    rows = df.collect()
    assert df.count() == len(rows)  # however the planner prunes
    assert sorted(tuple(norm(r[c]) for c in columns) for r in rows) == sorted(tuple(norm(r[i]) for i in at) for r in sql.fetchall())


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_nothing_else_needs_the_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "tidewatch.llm" or m.startswith("tidewatch.llm.") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidewatch.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    sys.modules.pop("__spark_entry__", None)
