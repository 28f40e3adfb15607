"""Every registered query that has a DuckDB statement against it, on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "events", "embeddings", "part", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    """Equal values in the same form: both zeros are one."""
    return repr(0.0) if isinstance(value, float) and value == 0 else repr(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    where = [names.index(c) for c in cols]
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    assert got == sorted([plain(r[i]) for i in where] for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["throttle", "emit_on_change", "recent_ids", "linear_scan", "hysteresis_bucket", "asof_reading"])
def test_query_over_narrow_slabs(spark, duck, monkeypatch, name):
    """The same over slabs of 40 of the tables' 259 seconds, which every room's rows cross."""
    monkeypatch.setattr(entry.registry.queries_ticks.V, "_fitted", lambda *_: 40.0)
    test_query_matches_duckdb(spark, duck, name)
