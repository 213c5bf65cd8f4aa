"""Groups against all pairs on full sets; blocks; the guarantee of the keys."""

import random

import numpy as np
import pytest

from millrace.llm import near_dedup as N


def corpus(seed=3, n=220):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.5 else "\n").join(w.upper() if rng.random() < 0.1 else w for w in copy))
    texts += ["", " ", "one", "ONE", "one two", "Ünder x y", "ünder x y"]
    rng.shuffle(texts)
    return texts[:n]


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = [x for x in t.encode().lower().split()]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def chains(seed=5):
    """Families that drift word by word: near neighbours link, ends do not; and families far from linking that share a core."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n in (60, 90):
        text = rng.choices(words, k=n)
        for _ in range(40):
            text[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(text))
    core = rng.choices(words, k=80)
    texts += [" ".join(core + rng.choices(words, k=rng.randrange(5, 30))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(
    "make, size, percent, block, bucket, star",
    [(corpus, 3, 85, 10**6, 4096, 1 << 16), (corpus, 5, 80, 150, 2, 300), (chains, 3, 85, 10**6, 4096, 1 << 16), (chains, 5, 80, 10**6, 2, 1), (chains, 3, 85, 400, 3, 300)],
)
def test_groups_equal_all_pairs(spark, monkeypatch, make, size, percent, block, bucket, star):
    monkeypatch.setattr(N, "FINE_SHINGLES", min(block, N.FINE_SHINGLES))
    texts = make()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = N.near_duplicates(df, size, percent, block, bucket, star).collect()
    want = brute(texts, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        chunks = N.chunk_count(percent)
        for _ in range(50):
            a = rng.integers(0, 2**16, (1, N.K)).astype(np.uint16)
            b = a.copy()
            at = rng.choice(N.K, 2 * chunks - 1, replace=False)
            b[0, at] ^= 1
            assert (N.chunk_keys(a, chunks) == N.chunk_keys(b, chunks)).any()


def test_bucket_forest_has_the_components_of_all_close_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.integers(0, 2**16, (4, N.K)).astype(np.uint16)
        sig = base[rng.integers(0, 4, 25)]
        for row in sig:
            row[rng.choice(N.K, rng.integers(0, 18), replace=False)] ^= 1
        far = (sig[:, None] != sig[None]).sum(axis=2) <= 20
        reach = far
        for _ in range(5):
            reach = (reach.astype(np.int64) @ reach.astype(np.int64)) > 0
        ties = N.bucket_forest(np.arange(25), sig, 20)
        assert all(far[a, b] for a, b in ties)
        assert joined(25, ties) == joined(25, [(a, b) for a in range(25) for b in range(25) if reach[a, b]])
        label, side = rng.integers(0, 12, 25), rng.integers(0, 2, 25)
        same = [(a, b) for a in range(25) for b in range(25) if label[a] == label[b]]
        across = [(a, b) for a in range(25) for b in range(25) if far[a, b] and side[a] != side[b]]
        assert joined(25, N.bucket_forest(np.arange(25), sig, 20, label, side) + same) == joined(25, across + same)


def joined(n, pairs):
    """The smallest member of each one's group."""
    low = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_rows_that_share_an_id_are_one_document(spark):
    long = " ".join(f"a{k}" for k in range(30))
    other = " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, long), (2, other), (2, long), (None, other)], "doc_id long, text string")
    out = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert out == [(-1, None, True), (1, 1, True), (2, 1, False), (2, 1, False)]
