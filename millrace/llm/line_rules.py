"""Quality rules: base counts of a text, and cross-document line frequency per host.

A line is normalised (letters lower-cased, digits to 0, runs of other characters than letters and digits to one space; a line
without letters and digits is taken as it is, without white space at its ends) and hashed with its host in 128 bits. A line that more
than ``max_docs`` distinct documents of a host hold is removed from all of them; a document that loses more than
``max_lost_percent`` of its words is depleted and rejected. Every line that has a word counts (``min_line_words`` can spare short ones).

The counts of a text come from one pass over its bytes. Lines are made distinct per document before the shuffle and
counted with a map-side combined aggregate; only lines above the limit meet the documents again. The table of those is written
before it is joined, as a join of two plain shuffles is one whose large keys adaptive execution can split: a line that a third of
all documents share is no single task.

Defined results: null and empty texts have no words and fail the base rule; very long texts are counted whole. Null sources are one
host. Rows without doc_id and repeated rows are judged by their content (copies of one row count once); a line at the limit exactly
stays. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

MAX_DOCS = 20
MIN_LINE_WORDS = 1
MAX_LOST_PERCENT = 60
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
#: What is neither a letter, a digit nor a line end, underlines apart.
_PLAIN = re.compile(r"[^\w\n]+")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(seq):
        return 0
    key = seq[:n].copy()
    for k in range(1, width):
        key = np.unique(key * len(ids) + seq[k : k + n], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    blanks, symbols = sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)] if "\n" in text else []
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_hashes(text: str, host: str | None, min_words: int) -> tuple[dict[bytes, list[int]], list[int]]:
    """Hash of each distinct normalised line with its host, to the numbers of such lines from 0; and the words of every line.

    The text is normalised as a whole, line ends apart.
    """
    out: dict[bytes, list[int]] = {}
    start = "\0" if host is None else f"{host}\n\0"
    sizes = [len(x.split()) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    plain = text.lower().replace("_", " ")
    for digit in "123456789":
        plain = plain.replace(digit, "0")
    plain = _PLAIN.sub(" ", plain).split("\n")
    for at, (n, line) in enumerate(zip(sizes, plain, strict=True)):
        if n >= max(1, min_words):
            line = line.strip() or text.split("\n")[at].strip(_BLANKS)
            out.setdefault(xxhash.xxh3_128_digest(f"{start}{line}".encode("utf-8", "surrogatepass")), []).append(at)
    return out, sizes


def _counted(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, places, sizes = [], [], [], []
            for text, host in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                counts.append(text_counts(text))
                lines, words = line_hashes(text, host.as_py(), min_words)
                hashes.append(list(lines))
                places.append(list(lines.values()))
                sizes.append(words)
            columns = list(zip(*counts, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4)]
                + [pa.array(c, pa.int64()) for c in columns]
                + [pa.array(hashes, pa.list_(pa.binary())), pa.array(places, pa.list_(pa.list_(pa.int32()))), pa.array(sizes, pa.list_(pa.int32()))],
                names=["doc_id", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "places", "line_words"],
            )

    return run


_COUNTS = "doc_id long, k1 long, k2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")
    ).withColumns({"k1": F.xxhash64("doc_id", "text", "source"), "k2": F.xxhash64("source", "text", "doc_id", F.lit("second"))})


def _judged(docs: DataFrame, max_docs: int, min_line_words: int, max_lost_percent: int) -> DataFrame:
    """The columns of ``line_frequency`` and the row's content key ``k1, k2``."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = _keyed(docs)
    counted = scratch.keep(
        rows.mapInArrow(_counted(min_line_words), f"{_COUNTS}, lines array<binary>, places array<array<int>>, line_words array<int>"), "counted"
    )
    lines = counted.select("k1", "k2", F.explode(F.arrays_zip("lines", "places")).alias("x")).select(
        "k1", "k2", F.col("x.lines").alias("line"), F.col("x.places").alias("places")
    )
    above = lambda df: df.groupBy("line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs).select("line")
    common = scratch.keep(above(lines.select("line")), "common")
    # Copies of one row would be counted as several documents: settle lines above the limit on distinct rows.
    sure = lines.join(common, "line").repartition("line", "k1", "k2").groupBy("line", "k1", "k2").agg(F.first("places").alias("places"))
    sure = scratch.keep(sure, "above")
    limits = scratch.keep(above(sure.select("line")), "limits")
    lost = sure.join(limits, "line").groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("removed"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * F.col("n_lost_words") > max_lost_percent * F.col("n_words")
    return (
        counted.join(lost.hint("merge"), ["k1", "k2"], "left")
        .withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<int>)")))
        .withColumn("n_lost_words", F.aggregate("removed", F.lit(0).cast("long"), lambda n, at: n + F.get("line_words", at)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select("k1", "k2", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "removed")
    )


def line_frequency(docs: DataFrame, max_docs: int = MAX_DOCS, min_line_words: int = MIN_LINE_WORDS, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Counts, ``n_lost_words``, ``base_failed``, ``kept`` and the numbers of ``removed`` lines, from 0, per row of ``docs(doc_id, text, source)``."""
    return _judged(docs, max_docs, min_line_words, max_lost_percent).drop("k1", "k2")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column(2), batch.column(4), strict=True):
            text, gone = text.as_py(), set(removed.as_py())
            texts.append("\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], names=["doc_id", "source", "text", "kept"])


def without_lines(docs: DataFrame, max_docs: int = MAX_DOCS, min_line_words: int = MIN_LINE_WORDS, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``(doc_id, source, text, kept)`` per row of ``docs(doc_id, text, source)``: the text without its removed lines."""
    judged = _judged(docs, max_docs, min_line_words, max_lost_percent).select("k1", "k2", "kept", "removed").dropDuplicates(["k1", "k2"])
    return (
        _keyed(docs).join(judged.hint("merge"), ["k1", "k2"])
        .select("doc_id", "source", "text", "kept", "removed")
        .mapInArrow(_left, "doc_id long, source string, text string, kept boolean")
    )


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_frequency(table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join(F.col("removed").cast("array<string>"), ",")).drop("removed")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), words AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM words WHERE i + 2 <= n) WHERE k > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, i - 1 AS place, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ''),
      regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS line,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), grouped AS (
  SELECT doc_id, source, line, sum(n) AS n, list(place) AS places FROM lines GROUP BY ALL
), lost AS (
  SELECT doc_id, sum(n) AS n_lost_words, array_to_string(list_sort(flatten(list(places))), ',') AS removed_lines
  FROM (SELECT *, count(*) OVER (PARTITION BY source, line) AS docs FROM grouped) WHERE docs > 20 GROUP BY doc_id
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines
  FROM t
), joined AS (
  SELECT c.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words,
    coalesce(removed_lines, '') AS removed_lines
  FROM counts c LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, removed_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * n_lost_words > 60 * n_words) AS kept
FROM joined
"""
