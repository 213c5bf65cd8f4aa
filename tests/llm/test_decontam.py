"""Contained items against plain sets: short items, all sizes, both kinds of joins, awkward rows and names."""

import random
import re

import pytest

from millrace.llm import decontam

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plainly(docs, items, percent=80, size=5):
    out = set()
    for item_id, item in items:
        w = words(item)
        k = min(size, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc_id, text in docs:
            d = words(text)
            both = want & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            if want and 100 * len(both) >= percent * len(want):
                out.add((doc_id, item_id, len(want), len(both)))
    return out


@pytest.mark.parametrize("most", [0, decontam.BROADCAST_BYTES])
def test_items_of_any_size_equal_plain_containment(spark, most):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 17, 24, 25, 33, 64, 65, 129, 400])]
    items += [(100, None), (101, ""), (102, " .,! "), (103, "Answer is: forty-two"), (103, "Answer is: forty-two"), (104, "日本語 テスト")]
    docs = [(1, "so the answer is forty two, they say"), (2, "forty two is answer the"), (None, "ANSWER IS FORTY TWO"), (None, None), (3, ""), (3, "x"), (4, "日本語、テスト"), (5, "a " * 30_000 + "answer is forty two")]
    for n, (_, text) in enumerate(items[:15]):
        w = text.split()
        docs.append((10 + n, " ".join(rng.choices(vocabulary, k=500)) + " | " + text.upper().replace(" ", ", ") + " | " + " ".join(rng.choices(vocabulary, k=30))))
        docs.append((30 + n, "zz " + " ".join(w[: max(1, len(w) * 85 // 100)])))
        docs.append((50 + n, "zz " + " ".join(x if rng.random() < 0.97 else "zz" for x in w)))
    docs += docs[:3]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontam.contained_items(df, known, broadcast_bytes=most).collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(docs, items)
    assert {(1, 103, 1, 1), (None, 103, 1, 1), (5, 103, 1, 1)} <= set(got)


def test_least_hits_cover_the_stated_chance():
    assert decontam.least_hits(24, 80) == 4 and decontam.least_hits(24, 100) == 24
    assert all(decontam.least_hits(decontam.sketch_size(p), 80) >= 1 for p in range(20))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "a b c d e f")], ITEMS), spark.createDataFrame([], ITEMS)
    assert [decontam.contained_items(d, i).count() for d, i in ((none, items), (some, no_items), (some, items))] == [0, 0, 1]


def test_stage_keeps_any_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "say one two three four five six now", 7, "a", 1, 2), (2, "clean", 8, None, 3, 4), (None, None, None, "c", 5, 6), (2, "clean", 8, None, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, row string, k1 int, found int")
    out = decontam.stage(spark, df, str(tmp_path))
    assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect()), key=str) == sorted(rows[1:], key=str)
