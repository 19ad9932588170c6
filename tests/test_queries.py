"""Every registered query with SQL against DuckDB, and the contract of the entry module."""

import glob
import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomspark.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.5f}"
    return str(x)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, sql = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "vector_score", "lexical_score", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("loomspark.llm") or m == "corpus_pipeline"]
    for m in [*gone, "loomspark.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, m, None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(registry.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
