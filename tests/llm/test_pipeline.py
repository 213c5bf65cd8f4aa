"""The pipeline against the plain versions of its stages; and every stage on awkward rows with clashing names."""

import re

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import line_crf, mixing
from millrace.llm.scratch import table
from tests.llm.test_decontam import plainly as contained
from tests.llm.test_mixing import plainly as mixed
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_pii import bootstrapped


def hidden(text, spans):
    """The text with its spans, listed as kind:start:end, replaced by their kinds."""
    out, end = "", 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) >= end:
            out += text[end : int(a)] + f"<{kind.upper()}>"
        end = max(end, int(b))
    return out + text[end:]


def test_pipeline_equals_the_plain_versions_of_its_stages(spark, sf):
    good = {r.doc_id for r in line_crf.op7_line_crf_quality(spark, sf).collect() if r.predicted}
    docs = [r for r in duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall() if r[0] in good]
    group = groups([t or "" for _, t, _ in docs], 5, 80)
    docs = [d for k, d in enumerate(docs) if group[k][1] == k]
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    leaked = {doc_id for doc_id, *_ in contained([d[:2] for d in docs], items)}
    docs = [d for d in docs if d[0] not in leaked]
    spans = bootstrapped([t for _, t, _ in docs])
    docs = [(d, hidden(t or "", x), s) for (d, t, s), x in zip(docs, spans, strict=True)]
    assert any(spans) and leaked and len(docs) > 50
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.n_shards) for r in out) == sorted(mixed(docs, mixing.BLOCK, mixing.SHARD_SLOTS))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "mixing_to_target_weights"]


def test_stages_of_empty_tables_are_empty(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and out.count() == 0


NAMES = ["k1", "k2", "row", "spans", "fresh", "rep", "label", "component", "node", "gone", "_key", "key", "size", "tie", "sid", "n", "found", "kept"]
LONG = "A very long text with words of all kinds and sizes goes on. " * 4000
TEXTS = [
    (1, "The first good text of them all, which says that a mail to me@site.org helps.\nAnd a second line.", "a"),
    (2, "The first good text of them all, which says that a mail to me@site.org helps.\nAnd a second line.", "b"),
    (2, "The first good text of them all, which says that a mail to me@site.org helps.\nAnd a second line.", "b"),
    (None, None, None),
    (None, None, None),
    (None, "A text without an identifier stays, whatever it is like, I should say.", None),
    (4, None, "a"),
    (5, "", ""),
    (6, " \n\t ", "a"),
    (7, LONG, "a"),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows_with_clashing_names(spark, tmp_path, name, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "never seen anywhere in these texts at all"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(*t, "en", None if t[1] is None else len(t[1]), *range(len(NAMES))) for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{x} int" for x in NAMES))
    out = stage(spark, df, str(tmp_path))
    if name == "mixing_to_target_weights":
        sizes = [(t[0], len(re.findall(r"[^\x20\x09-\x0D]+", t[1] or ""))) for t in TEXTS]
        assert sorted(map(str, sizes)) == sorted(str(tuple(r)) for r in out.select("doc_id", "size").collect())
        return
    assert out.dtypes == df.dtypes
    want = [list(r) for r in rows]
    if name == "minhash_near_dedup":
        want = [r for r in want if r[0] != 2]
    if name == "pii":
        want = [[r[0], r[1] and r[1].replace("me@site.org", "<EMAIL>"), *r[2:4], r[4] and r[4] - 4 * ("me@site" in r[1]), *r[5:]] for r in want]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)) for r in want)
