"""Queries against their SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidebook.plans import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.7g}" if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


#: These need more rows of a symbol than the smallest scale has.
LARGER = ("r2_walk_forward", "a22_stability", "l5_selection")


@pytest.mark.parametrize("name", sorted(n for n in catalog.SQL if n not in LARGER))
def test_same_as_sql(spark, duck, name):
    agree(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", LARGER)
def test_same_as_sql_with_more_rows(spark, name):
    c = duckdb.connect()
    c.execute("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    agree(catalog.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas(), c.execute(catalog.SQL[name]).df())


def agree(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = plain(ours), plain(theirs)
    assert len(a) == len(b)
    assert a == b


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert callable(entry.entry)


def test_as_of_joins_all_ticks(spark):
    seqs = sorted(r["seq"] for r in catalog.QUERIES["w17_running_index"](spark, SF).select("seq").collect())
    for name in ("nearest", "backward", "forward"):
        assert sorted(r["seq"] for r in catalog.QUERIES[f"j1_asof_{name}"](spark, SF).select("seq").collect()) == seqs


def test_all_quantities(spark):
    rows = catalog.QUERIES["j5_quantity_strategy"](spark, SF).collect()
    assert {r["target_qty"] for r in rows} == {100, 500, 1000, 2000}
