"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document if at least ``percent`` of its distinct word shingles occur there. Words are lower-cased
runs of letters and digits; an item of fewer words than a shingle is one shingle of all its words, and documents are probed for
runs of that many words too. The similarity of a short item and a long document is tiny, so sets are not compared as wholes:
items are partitioned by size, partition p holding those of up to 2**p shingles. An item's sketch is its ``sketch_size(p)``
smallest shingle hashes (all of them in the partitions of small items, where the count is exact). A document that contains
``percent`` of the item holds each sketch hash with that chance, so it shows fewer than ``least_hits`` with a chance
below ``MISS``.

Documents stream: their shingles probe the sketches where they are read, and only matches are shuffled, combined per
document and item. Candidates are verified on the shingles themselves, not on hashes. Sketches, and then candidates, are
broadcast only if their counted bytes stay below ``BROADCAST_BYTES``; else the same joins are shuffled.

Defined results: null and empty texts contain nothing and, as items, are found nowhere; texts of any length are probed whole.
Rows without doc_id are treated like others; rows that share doc_id and text give one row. Repeated items with one
item_id are one item if the texts agree; ties cannot matter, as every item above the limit is given. Other columns, whatever
their names, are ignored and kept by ``stage``. Empty tables give an empty result.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

MISS = 1e-11
BROADCAST_BYTES = 16 << 20
#: A broadcast row of numbers, with what the hash table takes beside it.
_ROW_BYTES = 80


def sketch_size(partition: int) -> int:
    """Hashes kept of an item of partition p, that is of up to 2**p shingles."""
    return 4 * (partition + 2)


def least_hits(size: int, percent: int) -> int:
    """What a document shows at least of ``size`` sketch hashes, each held with a chance of ``percent``."""
    share, chance = percent / 100, 0.0
    for k in range(size + 1):
        chance += comb(size, k) * share**k * (1 - share) ** (size - k)
        if chance >= MISS:
            return max(1, k)
    return size


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _windows(text: Column, size: int, each) -> Column:
    """``each(words, at)`` for all runs of ``size`` words, in order; none for texts with fewer.

    The word list is bound to a lambda variable, so it is made once a text.
    """

    def runs(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
        return F.slice(F.transform(at, lambda i: each(words, i)), 1, F.greatest(F.size(words) - size + 1, F.lit(0)))

    # The words of an empty text are one empty word.
    words = F.filter(F.split(plain_words(text), " "), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), runs), 1)


def shingle_hashes(text: Column, size: int) -> Column:
    return _windows(text, size, lambda words, i: F.xxhash64(F.lit(size), *(F.get(words, i + (k - 1)) for k in range(size))))


def shingle_texts(text: Column, size: int) -> Column:
    return F.array_distinct(_windows(text, size, lambda words, i: F.array_join(F.slice(words, i, size), " ")))


def _sized(df: DataFrame, n_bytes: int, most: int) -> DataFrame:
    """The table with a broadcast hint if it has been counted to be small, else one for a shuffled join."""
    return F.broadcast(df) if n_bytes <= most else df.hint("merge")


def _keyed(docs: DataFrame) -> DataFrame:
    """Document rows named by their content, in 128 bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(*_key(F.col("doc_id"), F.col("text")), "doc_id", "text")


def _key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit("second")).alias("k2")


def contained_items(docs: DataFrame, items: DataFrame, shingle_words: int = 5, percent: int = 80, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, k1, k2, item_id, n_shingles, n_shared, containment)``; k1 and k2 name the document's row by its content."""
    scratch = Scratch(docs.sparkSession, "decontam")
    by_size = {w: F.array_distinct(shingle_hashes(F.col("plain"), w)) for w in range(1, shingle_words + 1)}
    hashes = by_size[shingle_words]
    for w in range(1, shingle_words):
        hashes = F.when(F.col("width") == w, by_size[w]).otherwise(hashes)
    known = scratch.keep(
        items.select("item_id", plain_words(F.col("text").cast("string")).alias("plain"))
        .filter("plain <> ''")
        .distinct()
        .withColumn("width", F.least(F.size(F.split("plain", " ")), F.lit(shingle_words)))
        .withColumn("shingles", hashes)
        .withColumn("partition", F.ceil(F.log2(F.size("shingles"))).cast("int"))
        .withColumns({"i1": F.xxhash64("item_id", "plain"), "i2": F.xxhash64("plain", "item_id")}),
        "items",
    )
    # One number each: the widths of short items, below that of a shingle, and the partitions, powers of two.
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    partitions = sorted(r[0] for r in known.select("partition").distinct().collect())
    n, keep, least = F.size("shingles"), F.lit(0), F.lit(0)
    for p in partitions:
        size = sketch_size(p)
        here = F.col("partition") == p
        keep = F.when(here, F.lit(size)).otherwise(keep)
        least = F.when(here, F.when(n <= size, F.ceil(n * percent / 100)).otherwise(least_hits(size, percent))).otherwise(least)
    sketch = known.select(
        "i1", "i2", least.cast("int").alias("least"), F.explode(F.slice(F.array_sort("shingles"), F.lit(1), keep)).alias("h")
    )
    n_sketch = sketch.count()

    rows = _keyed(docs)
    found = F.concat(*(shingle_hashes(F.col("text"), w) for w in widths)) if widths else F.expr("cast(array() as array<long>)")
    candidates = scratch.keep(
        rows.select("k1", "k2", F.explode(found).alias("h"))
        .join(_sized(sketch, n_sketch * _ROW_BYTES, broadcast_bytes), "h")
        .groupBy("k1", "k2", "i1", "i2", "h")
        .agg(F.first("least").alias("least"))
        .groupBy("k1", "k2", "i1", "i2")
        .agg(F.count("*").alias("hits"), F.first("least").alias("least"))
        .filter("hits >= least")
        .join(known.select("i1", "i2", "item_id", "plain", "width"), ["i1", "i2"])
        .select("k1", "k2", "item_id", "plain", "width"),
        "candidates",
    )
    n_bytes = candidates.agg(F.sum(F.octet_length("plain") + 2 * _ROW_BYTES)).first()[0] or 0
    wide = {w: (shingle_texts(F.col("plain"), w), shingle_texts(F.col("text"), w)) for w in widths}
    none = F.expr("cast(array() as array<string>)")
    wanted = held = none
    for w, (item, doc) in wide.items():
        wanted, held = F.when(F.col("width") == w, item).otherwise(wanted), F.when(F.col("width") == w, doc).otherwise(held)
    return (
        rows.join(_sized(candidates, n_bytes, broadcast_bytes), ["k1", "k2"])
        .withColumn("wanted", wanted)
        .withColumn("n_shared", F.size(F.array_intersect("wanted", held)).cast("long"))
        .select("doc_id", "k1", "k2", "item_id", F.size("wanted").cast("long").alias("n_shingles"), "n_shared")
        .filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
        .withColumn("containment", F.try_divide("n_shared", "n_shingles"))
        .distinct()
    )


def op10_contained_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that contain a benchmark item. Rows travel as structs, so no column name can clash."""
    found = contained_items(docs, table(spark, sf_dir, "benchmark")).select("k1", "k2").distinct()
    found = Scratch(spark, "decontam").keep(found, "found")
    gone = _sized(found, found.count() * _ROW_BYTES, BROADCAST_BYTES)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.join(gone, ["k1", "k2"], "left_anti").select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), widths AS (
  SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE side = 'i' AND len(w) > 0
), s AS (
  SELECT DISTINCT side, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, widths WHERE len(w) >= k AND (side = 'd' OR k = least(len(w), 5))
), n AS (
  SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id
), c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM s d JOIN s i ON d.g = i.g AND d.k = i.k WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, c.k AS n_shared, c.k / n AS containment FROM c JOIN n ON n.id = c.item_id WHERE 100 * c.k >= 80 * n
"""
