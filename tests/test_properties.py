"""Random logs against plain Python models: one Spark job for many generated keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import dedup, machines, metrics, windows

T0 = dt.datetime(2024, 1, 1)


def test_positions_round_trip(spark):
    rng = random.Random(1)
    values = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.getrandbits(64) - 2**63 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "lsn long").withColumn("back", S.text_to_lsn(S.lsn_to_text(F.col("lsn"))))
    assert all(r.lsn == r.back for r in df.collect())


def test_folds_equal_models(spark):
    rng = random.Random(2)
    log = []
    for key in range(60):
        t = 0
        for n in range(rng.randrange(1, 30)):
            t += rng.choice([0, 1, 2, 5, 30])
            log.append((key, n, T0 + dt.timedelta(seconds=t), rng.randrange(4), rng.random() < 0.5))
    df = spark.createDataFrame(log, "k long, n long, ts timestamp_ntz, e long, ok boolean")

    def model(step, start):
        out, states = {}, {}
        for k, n, ts, e, ok in sorted(log, key=lambda r: (r[0], r[2], r[1])):
            states[k], out[k, n] = step(states.get(k, start), (ts - T0).total_seconds(), e, ok)
        return out

    def ttl(s, t, e, ok):
        return (t, True) if s is None or t >= s + 10 else (s, False)

    def counter(s, t, e, ok):
        a, n = s
        a, n = (t, 1) if a is None or t >= a + 10 else (a, n + 1)
        return (a, n), n <= 2

    def sliding(s, t, e, ok):
        s = tuple(x for x in s if x > t - 10)
        return (s + (t,), True) if len(s) < 3 else (s, False)

    got = lambda d, c: {(r.k, r.n): r[c] for r in d.collect()}
    assert got(dedup.ttl_dedup(df, ["k"], "ts", ["n"], 10), "is_new") == model(ttl, None)
    assert got(windows.anchored_counter(df, "k", "ts", ["n"], 10, 2), "allowed") == model(counter, (None, 0))
    assert got(windows.sliding_check_first(df, "k", "ts", ["n"], 10, 3), "allowed") == model(sliding, ())

    cas = got(dedup.compare_and_set(df, ["k"], ["n"], "e"), "version")
    for k in {x[0] for x in log}:
        versions = [cas[k, n] for n in sorted(n for kk, n, *_ in log if kk == k)]
        assert all(b - a in (0, 1) for a, b in zip([0, *versions], versions, strict=False))
    opened = got(machines.circuit_breaker(df, "k", "ts", ["n"], "ok", 2, 1, 10), "admitted")
    assert all(opened[k, 0] for k in {x[0] for x in log})


def test_nearest_rank_equals_sorting(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([0.0, -0.0, 1e-300, -1e300, 1e300, 3.5, -2.25, float("inf"), rng.uniform(-5, 5), float(rng.randrange(9))])
    data = [(rng.choice(["a", "b", None]), pick()) for _ in range(700)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for percent in (1, 50, 95, 100):
        got = {r.k: (r[f"p{percent}"], r.n) for r in metrics.nearest_rank(df, ["k"], "v", percent).collect()}
        want = {}
        for key in ("a", "b", None, "one"):
            values = sorted(v for k, v in data if k == key and v is not None)
            want[key] = (values[max(1, -(-len(values) * percent // 100)) - 1], len(values))
        assert got == want


def test_prefixes_of_any_kind(spark):
    names = ["", "a", "ab", "b", "\ud7ff", "\ud7ffz", "\ue000", "\U0010ffff", "\U0010ffffa", "z\U0010ffff", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for prefix in names:
        got = [r.n for r in metrics.prefix_search(df, "n", prefix, 50).collect()]
        assert sorted(got) == sorted(n for n in names if n.startswith(prefix)), repr(prefix)
