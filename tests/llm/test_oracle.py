"""The operators' queries that have SQL against DuckDB."""

import duckdb
import pytest

from tidemark.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = q.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
