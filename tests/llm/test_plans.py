"""Native operators run no Python on executors; no operator multiplies tables."""

import re

import pytest

from millrace.llm import decontam, licences, mixing, near_dedup, pii, repeats
from millrace.llm.scratch import Scratch, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def steps(monkeypatch):
    """Plans of all tables that an operator writes on its way."""
    seen, keep = [], Scratch.keep

    def watched(self, df, name):
        seen.append((name, plan(df)))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", watched)
    return seen


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: pii.find_pii(table(s, d, "documents")),
        lambda s, d: pii.stage(s, table(s, d, "documents"), d),
        lambda s, d: licences.scanned(table(s, d, "documents")),
        lambda s, d: mixing.taken_words(table(s, d, "documents")),
        lambda s, d: decontam.contained_items(table(s, d, "documents"), table(s, d, "benchmark")),
        lambda s, d: decontam.stage(s, table(s, d, "documents"), d),
    ],
)
def test_native(spark, sf, steps, run):
    steps.append(("result", plan(run(spark, sf))))
    for name, text in steps:
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow|CartesianProduct|BroadcastNestedLoop", text), name


@pytest.mark.parametrize("run", [lambda s, d: near_dedup.op8_minhash_near_dedup(s, d), lambda s, d: repeats.op9_run_length_repeats(s, d)])
def test_no_products(spark, sf, steps, run):
    steps.append(("result", plan(run(spark, sf))))
    assert not any(re.search("CartesianProduct|BroadcastNestedLoop", text) for _, text in steps)


def test_shuffled_form_of_a_search_gives_the_same(spark, sf):
    run = lambda: sorted(tuple(r) for r in decontam.op10_contained_benchmark_items(spark, sf).collect())
    want = run()
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = decontam.contained_items(docs, items, broadcast_bytes=-1).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")
    assert sorted(tuple(r) for r in got.collect()) == want and want
