"""Every core query against the SQL that states its rows, on the smallest tables."""

import decimal

import duckdb
import pytest

from millrace.plans import catalogue, monitoring, patterns, streams

QUERIES = catalogue.QUERIES | monitoring.QUERIES | patterns.QUERIES | streams.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v != v:
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert not any("HUGEINT" in str(d[1]) for d in out.description)
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in out.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
