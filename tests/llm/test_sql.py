"""Queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from folio.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    theirs = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in theirs.description)
    names = [d[0] for d in theirs.description]
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in columns) for r in theirs.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
