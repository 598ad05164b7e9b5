"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from reelspark.plans.catalog import QUERIES
from reelspark.plans.oracle import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) else str(v)


def comparable(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want = comparable([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "the query returned no rows"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
