"""Every query against its SQL in DuckDB, rows and values."""

import math
import os

import duckdb
import pytest

from folio.plans.all import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet{'/*' if os.path.isdir(f'{data}/{t}.parquet') else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float)) else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert normal(df.columns, df.collect()) == normal(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
