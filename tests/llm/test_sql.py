"""The SQL of the language-model queries against DuckDB over the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

from netquarry.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, str(SF))
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert got == sorted(cur.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(SF)).count() >= 0
