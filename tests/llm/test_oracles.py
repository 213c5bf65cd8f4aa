"""Queries of the subpackage against their SQL, on the smallest tables; and every operator on awkward tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, licences, line_crf, line_rules, mixing, near_dedup, pii, registry, render, repeats, warc
from millrace.llm.scratch import Scratch


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    out = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in out.description].index(c) for c in columns]
    assert len(out.description) == len(columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in out.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


SCHEMA = "key string, doc_id long, kept int, text string, source string, n int, lang string, component string, spans int, tie int, d int"
ROWS = [
    ("k", 5, 1, "One two three four five six seven eight nine ten.", "a", 1, "en", "c", 1, 1, 1),
    ("k", 3, 1, "One two three four five six seven eight nine ten.", "b", 1, "en", "c", 1, 1, 1),
    ("k", 3, 1, "One two three four five six seven eight nine ten.", "b", 1, "en", "c", 1, 1, 1),
    (None, 4, None, None, None, None, None, None, None, None, None),
    (None, None, None, "mail me@example.com now", None, None, None, None, None, None, None),
    ("k", 6, 1, "", "a", 1, "en", "c", 1, 1, 1),
    ("k", 7, 1, " \n\t ", "", 1, "en", "c", 1, 1, 1),
    ("k", 8, 1, "word " * 30_000, "a", 1, "en", "c", 1, 1, 1),
]


def _page(df):
    return df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url"), "key", "d", "kept")


def _warc(spark, df):
    path = Scratch(spark, "test").path("warc")
    warc.write_archives(_page(df), path)
    return warc.read_archives(spark, path)


OPERATORS = {
    "pii": lambda s, d: pii.find_pii(d),
    "line_rules": lambda s, d: line_rules.line_frequency(d),
    "warc": lambda s, d: _warc(s, d),
    "licences": lambda s, d: licences.scanned(d),
    "mixing": lambda s, d: mixing.taken_words(d),
    "render": lambda s, d: render.rendered(_page(d)),
    "line_crf": lambda s, d: line_crf.scores(d, line_crf.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "repeats": lambda s, d: repeats.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each_on_awkward_rows_and_none_on_empty_tables(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert OPERATORS[name](spark, df).count() == len(ROWS)
    assert OPERATORS[name](spark, df.limit(0)).count() == 0


def test_searches_on_awkward_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    items = spark.createDataFrame([(1, "x", "two three four five six seven"), (2, "y", "short"), (3, None, None), (None, "z", "two three four five six seven")], "item_id long, doc_id string, text string")
    got = sorted((r.doc_id, r.item_id or 0) for r in decontam.contained_items(df, items).collect())
    assert got == [(3, 0), (3, 1), (5, 0), (5, 1)]
    assert decontam.contained_items(df.limit(0), items).count() == 0
    assert decontam.contained_items(df, items.limit(0)).count() == 0
