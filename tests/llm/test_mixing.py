"""The mix against a plain version of the whole operator: targets, packing, draws, permutations, taken words."""

import random
import struct

import pytest
import xxhash

from millrace.llm import mixing
from tests.llm.test_rest import targets

SCHEMA = "doc_id long, text string, source string"


def spark_hash(*values):
    """xxhash64 of columns, as (value, bytes): each one's hash seeds the next; nulls are passed over."""
    seed = 42
    for value, width in values:
        if value is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q" if width == 8 else "<i", value), seed)
    return seed - ((seed >> 63) << 64)


def permuted(x, n, *salt):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash((mixing.SEED, 4), (r, 4), *salt) % n - x) % n
        if spark_hash((mixing.SEED + 1, 4), (r, 4), (max(x, other), 8), *salt) % 2:
            x = other
    return x


def shard_counts(n, per_shard):
    """(sid, shard): count, from draws with shares n / sum(n), the excess redrawn among those that lack slots."""
    total, draws = sum(n), []
    for k in range(total):
        u = spark_hash((mixing.SEED + 2, 4), (k, 8)) % total
        sid = next(s for s in range(len(n)) if sum(n[:s]) <= u < sum(n[: s + 1]))
        draws.append((sid, k // per_shard))
    counts, surplus = {}, []
    for s in range(len(n)):
        mine = sorted(shard for sid, shard in draws if sid == s)
        for shard in mine[: n[s]]:
            counts[s, shard] = counts.get((s, shard), 0) + 1
        surplus += mine[n[s] :]
    held = [sum(c for (s, _), c in counts.items() if s == k) for k in range(len(n))]
    lacking = [s for s in range(len(n)) for _ in range(n[s] - held[s])]
    for rank, shard in enumerate(surplus):
        s = lacking[permuted(rank, len(surplus), (mixing.SEED, 4))]
        counts[s, shard] = counts.get((s, shard), 0) + 1
    return counts


def plainly(docs, block, per_shard):
    """[(doc_id, size, taken, n_shards)], by laying out every word of every source."""
    names = sorted({s for _, _, s in docs}, key=lambda x: (x is None, (x or "").encode()))
    rows = [(d, len((t or "").split()), names.index(s), xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42) for d, t, s in docs]
    rows = [(d, size, sid, tie - ((tie >> 63) << 64)) for d, size, sid, tie in rows]
    sizes = [sum(r[1] for r in rows if r[2] == s) for s in range(len(names))]
    want = targets({names[s]: sizes[s] for s in range(len(names))})
    from math import isqrt

    buckets = max(8, isqrt(sum(r[1] > 0 for r in rows)))
    words = [min(round(want[names[s]]), 2 * sizes[s]) for s in range(len(names))]
    need = [0 if not sizes[s] else words[s] // sizes[s] * -(-sizes[s] // block) + -(-(words[s] % sizes[s]) // block) for s in range(len(names))]
    live = [s for s in range(len(names)) if need[s]]
    drawn = shard_counts([need[s] for s in live], per_shard)
    out = [(d, 0, 0, 0) for d, size, _, _ in rows if not size]
    for k, s in enumerate(live):
        low = lambda d: (d is not None, d or 0)
        mine = sorted((r for r in rows if r[2] == s and r[1]), key=lambda r: (spark_hash((r[0], 8), (r[3], 8)) % buckets, low(r[0]), r[1], r[3]))
        owner = [i for i, r in enumerate(mine) for _ in range(r[1])]
        taken, held = [0] * len(mine), [set() for _ in mine]
        blocks, full, number = -(-sizes[s] // block), sizes[s] // block, 0
        for shard in sorted(x for c, x in drawn if c == k):
            for _ in range(drawn[k, shard]):
                epoch, turn = divmod(number, blocks)
                index = permuted(turn, full, (s, 4), (epoch, 8)) if turn < full else turn
                take = block if epoch < words[s] // sizes[s] else min(block, words[s] % sizes[s] - turn * block)
                for i in owner[index * block : index * block + take]:
                    taken[i] += 1
                    held[i].add(shard)
                number += 1
        out += [(r[0], r[1], taken[i], len(held[i])) for i, r in enumerate(mine)]
    return out


@pytest.mark.parametrize("block, per_shard", [(7, 10), (16, 1000)])
def test_taken_words_equal_a_plain_version(spark, block, per_shard):
    rng = random.Random(block)
    docs = [(k, "w " * rng.randrange(0, 40) + str(k), rng.choice(["a", "é", "Z", None, "a"])) for k in range(60)]
    docs += [(None, "same words here", "a")] * 5 + [(3, "x y z", "a")] * 3 + [(None, None, "a"), (None, "", None), (9, " ", "b"), (900, "tiny one", "solo")]
    df = spark.createDataFrame(docs, SCHEMA)
    key = lambda t: (t[0] is not None, t)
    got = sorted(((r.doc_id, r.size, r.taken, r.n_shards) for r in mixing.taken_words(df, block, per_shard).collect()), key=key)
    assert got == sorted(plainly(docs, block, per_shard), key=key)


def test_shards_have_a_fixed_size_and_vary_in_sources(spark):
    docs = [(k, f"{k} " + "w " * 99, "abc"[k % 3]) for k in range(600)]
    out = mixing.shards(spark.createDataFrame(docs, SCHEMA), block=50, shard_slots=100).toPandas()
    per_slot = out.drop_duplicates(["source", "number"])
    assert set(per_slot.groupby("shard").size()[:-1]) == {100}
    counts = per_slot[per_slot["shard"] < 17].groupby(["source", "shard"]).size().unstack(0)
    share = counts.sum() / counts.sum().sum()
    spread = counts.var() / (100 * share * (1 - share))
    assert (counts.std() > 0).all() and spread.mean() < 3 and spread.mean() > 0.2
