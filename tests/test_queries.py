"""Every query with SQL against DuckDB over the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if n in entry.queries()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    key = lambda t: tuple(map(repr, t))
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
