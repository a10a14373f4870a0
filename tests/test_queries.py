"""Driver contract: entry() runs, and every registered query matches its DuckDB oracle
(row count, column names, order-insensitive values) on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from convspark.plans import catalog
from convspark.sources.tables import TABLES

from .conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "window_size", "pos", "role", "content"]
    assert df.count() > 0


def test_every_query_has_oracle():
    """Those of the training-data operators without a SQL form have brute-force tests of their own."""
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()], key=_key)
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted([tuple(_norm(r[i]) for i in idx) for r in res.fetchall()], key=_key)
    assert len(got) == len(want)
    assert got == want
