"""Removed bytes against a dictionary of all strings; the index against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import repeats as R


def brute(rows):
    seen, out = set(), {}
    for i, b in sorted(rows):
        mark = bytearray(len(b))
        for q in range(len(b) - R.LENGTH + 1):
            s = b[q : q + R.LENGTH]
            if s in seen:
                mark[q : q + R.LENGTH] = b"\1" * R.LENGTH
            seen.add(s)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1]))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randrange(0, 120)))
        if rng.random() < 0.5:
            a = rng.randrange(100)
            t = t[: len(t) // 2] + passage[a : a + rng.randrange(90, 260)] + t[len(t) // 2 :]
        if texts and rng.random() < 0.3:
            t = rng.choice(texts)
            k = rng.randrange(len(t) + 1)
            t = t[:k] + "!" + t[k:]
        texts.append(t)
    return texts + ["z" * 350, "z" * 120, "", "ab" * 200, "q" * 99, "q" * 100, "q" * 101]


@pytest.mark.parametrize("seed, hot, seen", [(1, R.HOT, None), (2, 2, None), (3, R.HOT, 2), (4, 3, 1)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, hot, seen):
    if seed % 2 == 0:
        monkeypatch.setattr(R, "FETCHED_ROWS", 5)
        monkeypatch.setattr(R, "FETCHED_STRINGS", 100)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = df.selectExpr("doc_id AS d", "0L AS e", "cast(text AS binary) AS data")
    routed = seen and R.crowded(rows, 1, seen)
    assert seen is None or len(routed)
    got = {r[0]: tuple(r[1:]) for r in R.remove_repeats(df, hot, routed).collect()}
    assert got == brute([(k, t.encode()) for k, t in enumerate(texts)])


def test_spans_and_kept_bytes_can_be_had(spark, monkeypatch):
    monkeypatch.setattr(R, "OUT_BYTES", 300)
    texts = [t.encode() for t in corpus(3)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = brute(list(enumerate(texts)))
    rows = R.without_repeats(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, at, left = texts[r.doc_id], 0, b""
        for x in r.spans:
            left += text[at : x["at"]]
            at = x["to"]
        assert bytes(r.kept) == left + text[at:]
        assert want[r.doc_id] == (len(text), len(text) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 700)
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8)) * 2
    column, out = R.pa.array([text], R.pa.binary()), []
    for b in R._scan(iter([R.pa.RecordBatch.from_arrays([R.pa.array([1]), R.pa.array([0], R.pa.int64()), column], names=["d", "e", "data"])])):
        out += b.column(4).to_pylist()
    whole = R.anchors(np.frombuffer(text, dtype=np.uint8), np.array([len(text)]))[0]
    assert sorted(out) == whole.tolist()


def test_rows_that_share_an_id_follow_each_other(spark):
    a, b = "x1 " * 60, "".join(chr(97 + k % 26) + str(k) for k in range(80))
    df = spark.createDataFrame([(1, b), (1, a), (1, b), (None, b)], "doc_id long, text string")
    out = sorted(((r.doc_id or 9), r.n_bytes, r.n_removed) for r in R.remove_repeats(df).collect())
    size = len(b.encode())
    assert [x for x in out if x[1] == size] == [(1, size, 0), (1, size, size), (9, size, size)]


def test_rows_without_id_follow_the_others_in_the_order_of_their_texts(spark):
    texts = [t.encode() for t in corpus(5)]
    rows = [(k, t) for k, t in enumerate(texts[:20])] + [(None, t) for t in texts[20:]] + [(None, texts[21])] * 9 + [(3, texts[30])]
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = brute(list(enumerate(t for _, t in order)))
    got = sorted(((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in R.remove_repeats(df).collect()))
    assert got == sorted((d is None, d or 0, *want[k]) for k, (d, _) in enumerate(order))


def test_copies_add_no_runs():
    rng = np.random.default_rng(1)
    once = rng.integers(1, 200, 2000).astype(np.int16)
    runs = lambda n: len(R.RunIndex(np.append(np.tile(once, n), 0).astype(np.int16)).at)
    assert runs(20) < runs(1) + 50


def test_index_statistics():
    rng = np.random.default_rng(2)
    text = np.append(np.tile(rng.integers(1, 4, 60), 4), 0).astype(np.int16)
    sa, _ = R.suffix_order(text)
    suffix = [text[k:].tolist() for k in range(len(text))]
    assert sa.tolist() == sorted(range(len(text)), key=lambda k: suffix[k])
    length, previous = R.RunIndex(text).statistics()
    for rank in range(1, len(sa)):
        a, b = suffix[sa[rank - 1]], suffix[sa[rank]]
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (length[sa[rank]], previous[sa[rank]]) == (same, sa[rank - 1])
