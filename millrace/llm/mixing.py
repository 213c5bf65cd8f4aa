"""Mixing sources to target weights.

Plan
----
1. Documents are sized in words; sources get targets by weight, limited to ``cap`` times their size (water-filling). A target is
   a number of slots, each of which takes a block.
2. Each source's words are packed into blocks of ``block`` words: documents in the order of (bucket, doc_id), their
   offsets from a two-level running sum over the square root of all rows as buckets, so that a source with a third of
   all rows is no single task. Equal rows are packed as one row with a count, and dealt out again by copy.
3. Output shards hold ``shard_slots`` slots. Each slot draws its source with the targets' shares, so a shard's source counts are
   a multinomial draw. What a source is drawn beyond its slots, over all shards, is redrawn among the sources that still lack some:
   so totals are at the targets and no document exceeds ``cap`` times its size, which free draws could not hold.
4. Shard by shard, the counts give a source's slots consecutive numbers; a pseudorandom permutation of the source (swap-or-not
   network, any length) maps the number to a block index. A source takes its blocks in epochs: whole ones, then a part, until the
   target is reached exactly. A short last block comes last in its epoch.
5. Slots meet blocks by (source, index), always in a shuffled join: both grow with the data, which sizes taken before
   rows are exploded do not show. A document's taken words are the overlaps of its pieces with taken slots.

All draws are hashes of seed and number, so reruns agree. Everything runs as built-in expressions.

Defined results: null and empty texts have size 0 and are taken 0 times; null sources form the last source; rows without
doc_id and repeated rows are documents of their own, and of equal ones any may be taken; very long texts are packed whole; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, parts, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 256
SHARD_SLOTS = 4096
SEED = 17
ROUNDS = 12
_CHUNK = 4096


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, sid, source_size, target)``: sid numbers sources by code point from 0, null last.

    One row per source, so its windows are small whatever the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy("full_at", "sid")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    n = len(weights)
    s = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % n + 1).cast("double"))
        .withColumn("limit", F.col("source_size") * float(cap))
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("nth", F.row_number().over(rank))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("nth"))).over(everything))
    )
    target = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit"))
    return s.select("source", "sid", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: swap-or-not rounds, each its own inverse."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *salt), n) - at, n)
        bit = F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *salt) % 2
        return F.when(bit != 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def _exploded(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each of 0..n-1, in two steps so that no array grows with the data."""
    chunks = df.withColumn("_c", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {_CHUNK})")))
    chunks = chunks.repartition(parts(df.sparkSession), *df.columns, "_c")
    return chunks.withColumn(
        name, F.explode(F.expr(f"sequence(_c * {_CHUNK}, least({n}, (_c + 1) * {_CHUNK}) - 1)"))
    ).drop("_c")


def _before(value: str, *order: str) -> Column:
    """Running sum of the rows before, over a table of one row per source."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def drawn_counts(plan: DataFrame, scratch: Scratch, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(sid, shard, count)`` of ``plan(sid, n)``: each of the sum of ``n`` slots draws a source with the share n has of it.

    A draw is a number below the sum, so sources are intervals; they are found by cells of the number line, as an equality
    join. Draws beyond a source's n are redrawn: they are numbered, and meet the slots that others lack in a pseudorandom order.
    """
    everything = Window.partitionBy(F.lit(0))
    spread = plan.withColumns({"total": F.sum("n").over(everything), "sources": F.count("*").over(everything), "lo": _before("n", "sid")})
    spread = scratch.keep(spread.withColumn("width", F.ceil(F.col("total") / (2 * F.col("sources")))), "shares")
    cells = spread.withColumn("cell", F.explode(F.expr("sequence(lo div width, (lo + n - 1) div width)"))).select("sid", "lo", "n", "cell")
    total, width = spread.select("total", "width").first() or (0, 1)
    draw = F.col("id")
    draws = plan.sparkSession.range(0, total, 1, max(parts(plan.sparkSession), total >> 22)).select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 2), draw), F.lit(max(total, 1))).alias("u")
    )
    counts = scratch.keep(
        draws.withColumn("cell", F.expr(f"u div {width}"))
        .join(cells, "cell")
        .filter("u >= lo and u < lo + n")
        .groupBy("sid", "shard")
        .agg(F.count("*").alias("count")),
        "draws",
    )
    held = counts.groupBy("sid").agg(F.sum("count").alias("held"))
    balance = spread.select("sid", "n").join(held, "sid", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    balance = balance.withColumns({"over": F.greatest(F.col("held") - F.col("n"), F.lit(0)), "lack": F.greatest(F.col("n") - F.col("held"), F.lit(0))})
    balance = scratch.keep(balance.withColumns({"over_at": _before("over", "sid"), "lack_at": _before("lack", "sid"), "moved": F.sum("over").over(everything)}), "balance")
    upto = F.sum("count").over(Window.partitionBy("sid").orderBy("shard"))
    split = (
        counts.withColumn("at", upto - F.col("count"))
        .join(balance.select("sid", "n", "over_at", "moved"), "sid")
        .withColumn("kept", F.greatest(F.least(F.col("n") - F.col("at"), F.col("count")), F.lit(0)))
        .withColumn("extra", F.col("count") - F.col("kept"))
    )
    extra = _exploded(
        split.filter("extra > 0").select("shard", "extra", "moved", (F.col("over_at") + F.greatest(F.col("at") - F.col("n"), F.lit(0))).alias("from")), "extra", "k"
    ).select("shard", permuted(F.col("from") + F.col("k"), F.col("moved"), F.lit(SEED)).alias("place"))
    lacking = _exploded(balance.filter("lack > 0").select("sid", "lack", "lack_at"), "lack", "k").select("sid", (F.col("lack_at") + F.col("k")).alias("place"))
    redrawn = extra.join(lacking, "place").groupBy("sid", "shard").agg(F.count("*").alias("count"))
    kept = split.filter("kept > 0").select("sid", "shard", F.col("kept").alias("count"))
    return kept.unionByName(redrawn).groupBy("sid", "shard").agg(F.sum("count").alias("count"))


def slots(targets: DataFrame, scratch: Scratch, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, sid, number, epoch, index, take)``: which block each slot takes, and how many of its words."""
    plan = (
        targets.filter("source_size > 0")
        .withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * CAP))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("whole", F.expr("words div source_size"))
        .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
        .withColumn("n", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block))
        .filter("n > 0")
    )
    counts = drawn_counts(plan.select("sid", "n"), scratch, shard_slots)
    placed = counts.withColumn(
        "first", F.sum("count").over(Window.partitionBy("sid").orderBy("shard")) - F.col("count")
    ).join(plan.select("sid", "blocks", "whole", "rest", "source_size"), "sid")
    numbered = _exploded(placed, "count", "k").withColumn("number", F.col("first") + F.col("k"))
    full = F.expr(f"source_size div {block}")
    return (
        numbered.withColumn("epoch", F.expr("number div blocks"))
        .withColumn("turn", F.col("number") - F.col("epoch") * F.col("blocks"))
        .withColumn("index", F.when(F.col("turn") < full, permuted(F.col("turn"), F.greatest(full, F.lit(1)), F.col("sid"), F.col("epoch"))).otherwise(F.col("turn")))
        .withColumn("take", F.when(F.col("epoch") < F.col("whole"), block).otherwise(F.least(F.lit(block), F.col("rest") - F.col("turn") * block)))
        .select("shard", "sid", "number", "epoch", "index", F.col("take").cast("long").alias("take"))
    )


def packed(sized: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pieces of documents with words in blocks: the input's columns, which ``copy`` of equal rows it is, its offset ``off``, block ``index``, and from, to in the block."""
    buckets = max(8, isqrt(sized.count()))
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = scratch.keep(
        sized.groupBy(*sized.columns)
        .agg(F.count("*").alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
        .withColumn("inner", F.sum(F.col("size") * F.col("copies")).over(order)),
        "offsets",
    )
    bases = (
        rows.groupBy("sid", "bucket")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("held"))
        .withColumn("base", F.sum("held").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("held"))
        .drop("held")
    )
    placed = rows.join(scratch.keep(bases, "bases"), ["sid", "bucket"]).withColumn("at", F.col("base") + F.coalesce("inner", F.lit(0))).drop("inner", "base", "bucket")
    each = placed.filter("copies = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(_exploded(placed.filter("copies > 1"), "copies", "copy"))
    pieces = each.withColumn("off", F.col("at") + F.col("copy") * F.col("size")).withColumn(
        "index", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})"))
    )
    return (
        pieces.withColumn("from", F.greatest(F.col("off") - F.col("index") * block, F.lit(0)))
        .withColumn("to", F.least(F.col("off") + F.col("size") - F.col("index") * block, F.lit(block)))
        .drop("at", "copies")
    )


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces of all documents with words; the slots that take blocks, both with (sid, index); and the documents without words."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col("text").cast("string")
    sized = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
        "sized",
    )
    targets = scratch.keep(source_targets(sized), "targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", sized["source"], "size", "tie", "sid", "source_size", "target")
    return packed(rows.filter("size > 0"), scratch, block), slots(targets, scratch, block, shard_slots), rows.filter("size = 0")


def shards(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mixed corpus as rows (shard, number, source, from, doc_id, first_word, n_words), a row for each piece of a slot."""
    pieces, taken, _ = mix(docs, block, shard_slots)
    n = F.least("to", "take") - F.col("from")
    return (
        taken.hint("merge")
        .join(pieces, ["sid", "index"])
        .withColumn("n_words", n)
        .filter("n_words > 0")
        .select("shard", "number", "source", "from", "doc_id", (F.col("index") * block + F.col("from") - F.col("off")).alias("first_word"), "n_words")
    )


def taken_words(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, n_shards)`` per document; n_shards: in how many output shards its words are."""
    pieces, taken, empty = mix(docs, block, shard_slots)
    words = F.greatest(F.least("to", F.coalesce("take", F.lit(0))) - F.col("from"), F.lit(0))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "n_shards"]
    found = (
        pieces.join(taken.select("sid", "index", "take", "shard").hint("merge"), ["sid", "index"], "left")
        .withColumn("words", words)
        .groupBy("doc_id", "source", "sid", "tie", "copy", "size", "source_size", "target")
        .agg(F.sum("words").cast("long").alias("taken"), F.size(F.collect_set(F.when(F.col("words") > 0, F.col("shard")))).cast("long").alias("n_shards"))
    )
    zero = F.lit(0).cast("long")
    return found.select(*out).unionByName(empty.withColumns({"taken": zero, "n_shards": zero}).select(*out))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix over what is left: for each document, how many of its words are taken."""
    return taken_words(docs)
