"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit signatures.

Plan
----
1. Every text becomes its set of word shingles (64-bit hashes). Equal sets form a class; its smallest
   doc_id represents it, so exact copies never meet again.
2. A class has K min-hash symbols of b bits. Two sets of similarity J differ in Binomial(K, 1-J) symbols.
3. Pigeonhole: K symbols in m chunks; signatures within distance t < 2m agree in some chunk up to one symbol.
   Each chunk is therefore indexed once per symbol left out (the allowed chunk error), which guarantees that
   all pairs within distance t share a key. m is chosen so that a pair at the threshold is beyond t with a chance
   below ``MISS``.
4. Stars: of the smallest classes under its keys, each class is confirmed on the full sets against the smallest one within
   distance t. Linked ones get a common label. A family of near copies, however large, is mostly settled here, in time linear in it.
5. Ties: only keys that still hold several labels are looked at, by one class for each label and signature. Pairs of different labels within
   distance t are tied to a forest (as many ties as members at most, never all pairs). Classes that only share some passage are too
   far apart for a tie, so that they form no large components. The rows of a key are dealt out to chunks of ``BUCKET_ROWS``, and each
   pair of chunks is a task of its own. Components of stars and ties hold every pair within distance t.
6. Components with several labels are cut into blocks of bounded size. Labels larger than a block have blocks of their own,
   which are not compared with each other; each other pair of blocks is one task that compares signatures across labels, confirms
   candidates on the full sets and returns the links of a spanning forest.
7. Components of the confirmed links are the groups.

Counts by key, and other small sides of joins, are combined aggregates that are written first: a join of two plain shuffles is one
whose large keys adaptive execution can split, so no key is a single task.

Defined results: null, empty or blank texts have an empty set, link with nothing and are their own component; very long texts count
whole. Texts with fewer words than a shingle have their whole word sequence as the one shingle. A pair at the threshold exactly links.
A row without doc_id links with nothing, its component_id is null and it is kept. Rows that share a doc_id are one document. Other
input columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, table

K = 64
MISS = 1e-5
#: A block holds at most so many shingles, and a component is cut into ``BLOCKS`` unless those would be smaller than ``FINE_SHINGLES``.
BLOCK_SHINGLES = 1_000_000
FINE_SHINGLES = 1 << 15
BLOCKS = 16
BUCKET_ROWS = 4096
#: A star's members come in chunks of so many shingles, each with the star's centre.
STAR_SHINGLES = 1 << 16

_U = np.uint64
_MIX1, _MIX2, _MIX3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Word bytes to 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; A-Z lower-cased, words split at ASCII white space."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.empty(0, dtype=np.uint64)
    h = np.array([words[w] for w in split], dtype=np.uint64)
    take = min(size, len(h))
    n = len(h) - take + 1
    out = np.full(n, take, dtype=np.uint64)
    for k in range(take):
        out = _mixed(out * _MIX1 + h[k : k + n])
    return np.unique(out)


_RNG = np.random.default_rng(20_11)
_A = _RNG.integers(1, 2**63, K, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 2**63, K, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """K symbols of 16 bits: the mixed minimum under each of K permutations of the hashes."""
    low = np.full(K, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048, None] * _A + _B
        low = np.minimum(low, part.min(axis=0))
    return (_mixed(low) >> _U(48)).astype(np.uint16)


def chunk_count(percent: int) -> int:
    """Chunks needed so that pairs at the threshold exceed the guaranteed distance with a chance below ``MISS``."""
    far = 1 - percent / 100
    for m in range(1, K // 2):
        if sum(comb(K, k) * far**k * (1 - far) ** (K - k) for k in range(2 * m, K + 1)) < MISS:
            return m
    return K // 2


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(n, K) symbols to (n, K) keys: chunk by chunk, the chunk's other symbols when one is left out."""
    keys = np.empty(sig.shape, dtype=np.uint64)
    wide = sig.astype(np.uint64)
    edges = np.linspace(0, K, chunks + 1).round().astype(int).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for out in range(lo, hi):
            h = np.full(len(sig), out + 1, dtype=np.uint64)
            for k in range(lo, hi):
                if k != out:
                    h = _mixed(h * _MIX2 + wide[:, k])
            keys[:, out] = h
    return keys


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, count, prints, sigs = batch.column(0), [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size, words)
                count.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(count, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "print", "sig"],
            )

    return run


def _keyed(chunks: int):
    """Signatures to (key, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, K)
                keys = chunk_keys(sig, chunks).view(np.int64)
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), K)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep, pa.int64())], names=["key", "rep"])

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, su, sv) to (u, v, far): the distance of two signatures."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, K) for k in (2, 3))
            far = pa.array((a != b).sum(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), far], names=["u", "v", "far"])


def _starred(size: int, percent: int):
    """Rows (centre, chunk, rep, text), the centre first in its group, to links (u, v) with the centre. One set is kept at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, held = Words(), None, None
        for batch in batches:
            u, v = [], []
            for centre, chunk, rep, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                centre, rep = centre.as_py(), rep.as_py()
                s = shingles(text.as_py(), size, words)
                if centre == rep:
                    at, held = (centre, chunk.as_py()), s
                elif at != (centre, chunk.as_py()):
                    raise ValueError("a star's centre is missing")
                elif similar(held, s, percent):
                    u.append(centre)
                    v.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def bucket_forest(rep: np.ndarray, sig: np.ndarray, furthest: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one bucket whose signatures are within the distance.

    Rows with one label are joined already; with ``side`` only pairs of both sides count. Of a group the nearest row is tied.
    """
    root, out = np.arange(len(rep)) if label is None else np.unique(label, return_inverse=True)[1], []
    for i in range(1, len(rep)):
        far = (sig[:i] != sig[i]).sum(axis=1)
        near = (far <= furthest) & (root[:i] != root[i])
        if side is not None:
            near &= side[:i] != side[i]
        near = np.flatnonzero(near)
        if len(near):
            near = near[np.argsort(far[near], kind="stable")]
            groups, first = np.unique(root[near], return_index=True)
            out += [(int(rep[near[k]]), int(rep[i])) for k in first]
            root[np.isin(root, np.append(groups, root[i]))] = groups[0]
    return out


def _bucketed(furthest: int):
    """Rows (task, cross, rep, label, side, sig) sorted by task to ties (u, v) of each task's forest; tasks of two rows go all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint16).reshape(-1, K)
                fresh = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [sig]
                held = [np.concatenate(x) for x in zip(held, fresh, strict=True)] if held else fresh
            if not held:
                return
            task, cross, rep, label, side, sig = held
            edge = np.flatnonzero(task[1:] != task[:-1]) + 1
            starts, stops = np.append(0, edge), np.append(edge, len(task))
            whole = len(starts) if batch is None else len(starts) - 1
            cut = stops[whole - 1] if whole else 0
            starts, size = starts[:whole], (stops - starts)[:whole]
            two = starts[size == 2]
            far = (sig[two] != sig[two + 1]).sum(axis=1)
            near = (far <= furthest) & (label[two] != label[two + 1])
            ties = [np.stack([rep[two], rep[two + 1]], axis=1)[near]]
            for a, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                part = slice(a, a + n)
                found = bucket_forest(rep[part], sig[part], furthest, label[part], side[part] if cross[a] else None)
                ties.append(np.array(found, dtype=np.int64).reshape(-1, 2))
            found = np.concatenate(ties)
            held = [x[cut:] for x in held] if cut < len(task) else []
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(2)], names=["u", "v"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(sets: list[np.ndarray], sig: np.ndarray, label: np.ndarray, left: int, percent: int, whole: bool, furthest: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs with 100 * intersection >= percent * union.

    ``whole``: all pairs of the list; else only pairs of one of the first ``left`` with one of the others.
    Candidates are pairs within the signature distance; pairs of one label, or joined already, need no comparison.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.unique(label, return_inverse=True)[1]
    for i in range(0 if whole else left, n):
        upto = i if whole else left
        near = np.flatnonzero(
            (100 * np.minimum(size[:upto], size[i]) >= percent * np.maximum(size[:upto], size[i])) & (root[:upto] != root[i])
        )
        if not len(near):
            continue
        far = (sig[near] != sig[i]).sum(axis=1)
        near, far = near[far <= furthest], far[far <= furthest]
        for j in near[np.argsort(far, kind="stable")].tolist():
            if root[j] != root[i] and similar(sets[i], sets[j], percent):
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
                yield j, i


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _sets(size: int):
    """Rows (component, rep, label, block, others, sig, text) with the sorted shingles in place of the text: they go to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            made = pa.array([shingles(x.as_py(), size, words).tobytes() for x in batch.column(6)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], made], names=[*batch.schema.names[:6], "shingles"])

    return run


def _linked(percent: int):
    """Rows (component, bi, bj, block, rep, label, sig, shingles), sorted by the first three, to links."""
    furthest = 2 * chunk_count(percent) - 1

    def flush(key, rows) -> pa.RecordBatch:
        _, bi, bj = key
        rows.sort(key=lambda r: (r[1] != bi, r[0]))
        left = sum(r[1] == bi for r in rows)
        label, sets = np.array([r[2] for r in rows]), [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
        sig = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint16).reshape(-1, K)
        pairs = list(confirmed(sets, sig, label, left, percent, bi == bj, furthest)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[a][0] for a, _ in pairs], pa.int64()), pa.array([rows[b][0] for _, b in pairs], pa.int64())],
            names=["u", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for comp, bi, bj, block, *row in zip(*columns, strict=True):
                if (comp, bi, bj) != at:
                    if rows:
                        yield flush(at, rows)
                    at, rows = (comp, bi, bj), []
                rows.append((row[0], block, *row[1:]))
        if rows:
            yield flush(at, rows)

    return run


def _confirmed_with(chosen: DataFrame, docs: DataFrame, size: int, percent: int, star_shingles: int, scratch: Scratch) -> DataFrame:
    """Links among ``chosen(u, v, n)``, u below v, n the shingles of v: a centre u goes along with chunks of its members."""
    chosen = scratch.keep(chosen, "centres")
    chunks = scratch.keep(chosen.groupBy("u").agg(F.ceil(F.sum("n") / F.lit(star_shingles)).cast("int").alias("k")), "chunks")
    members = chosen.join(chunks, "u").select(F.col("u").alias("centre"), F.pmod(F.xxhash64("v"), F.col("k")).cast("int").alias("chunk"), F.col("v").alias("rep"))
    centres = members.select("centre", "chunk").distinct().withColumn("rep", F.col("centre"))
    rows = members.unionByName(centres).hint("merge").join(docs, F.col("rep") == docs.doc_id).select("centre", "chunk", "rep", "text")
    tasks = rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "rep")
    return scratch.keep(tasks.mapInArrow(_starred(size, percent), "u long, v long"), "stars")


def _stars(buckets: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, furthest: int, scratch: Scratch, star_shingles: int) -> DataFrame:
    """Confirmed links of each class with the smallest near one of the smallest classes under its keys."""
    sig = classes.select("rep", "sig")
    pairs = buckets.filter("rep > low").select(F.col("low").alias("u"), F.col("rep").alias("v")).distinct()
    signed = (
        pairs.hint("merge")
        .join(sig.select(F.col("rep").alias("v"), F.col("sig").alias("sv")), "v")
        .join(sig.select(F.col("rep").alias("u"), F.col("sig").alias("su")), "u")
        .select("u", "v", "su", "sv")
    )
    near = signed.mapInArrow(_distances, "u long, v long, far int").filter(F.col("far") <= furthest)
    chosen = near.groupBy("v").agg(F.min("u").alias("u")).join(classes.select(F.col("rep").alias("v"), "n"), "v")
    return _confirmed_with(chosen.select("u", "v", "n"), docs, size, percent, star_shingles, scratch)


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df(rep, ..)`` with the label that confirmed links give, the class itself without any."""
    return df.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _ties(buckets: DataFrame, classes: DataFrame, labels: DataFrame, furthest: int, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """A forest of near signatures under each key that holds several labels."""
    marked = scratch.keep(_labelled(buckets.select("key", "rep"), labels), "marked")
    several = marked.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("key")
    open_rows = marked.join(scratch.keep(several, "several"), "key").hint("merge").join(classes.select("rep", "sig"), "rep")
    one_each = scratch.keep(open_rows.groupBy("key", "label", "sig").agg(F.min("rep").alias("rep")), "open")
    count = scratch.keep(one_each.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket_rows)).cast("int").alias("nb")), "chunks")
    dealt = one_each.join(count, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = _paired(dealt, F.expr("sequence(0, nb - 1)")).withColumn("task", F.when(F.col("nb") == 1, F.col("key")).otherwise(F.xxhash64("key", "bi", "bj")))
    rows = dealt.select("task", F.expr("bi < bj").alias("cross"), "rep", "label", "block", "sig")
    return rows.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(_bucketed(furthest), "u long, v long")


def _paired(rows: DataFrame, others: Column) -> DataFrame:
    """Each row once for each block its own is compared with, as (bi, bj)."""
    met = rows.withColumn("other", F.explode(others))
    return met.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")


def _blocks(near: DataFrame, block_shingles: int, scratch: Scratch) -> DataFrame:
    """``near(component, rep, label, n, sig)`` with ``block`` and ``others``, the blocks it is compared with; settled components are left out.

    Labels larger than a block have blocks of their own after those of the others.
    """
    per = scratch.keep(near.groupBy("component", "label").agg(F.sum("n").alias("held")), "labels")
    whole = per.groupBy("component").agg(F.count("*").alias("k"), F.sum("held").alias("all")).filter("k > 1")
    size = F.least(F.lit(float(block_shingles)), F.greatest(F.lit(float(FINE_SHINGLES)), F.col("all") / BLOCKS))
    sized = scratch.keep(per.join(whole.select("component", size.alias("size")), "component"), "sized")
    big = F.col("held") > F.col("size")
    pool = scratch.keep(sized.groupBy("component").agg(F.ceil(F.coalesce(F.sum(F.when(~big, F.col("held") / F.col("size"))), F.lit(0.0))).cast("int").alias("pool")), "pool")
    own = sized.filter(big).join(pool, "component").withColumn("nb", F.ceil(F.col("held") / F.col("size")).cast("int"))
    # Labels larger than a block are few: as many as the component has blocks.
    upto = F.sum("nb").over(Window.partitionBy("component").orderBy("label"))
    own = scratch.keep(own.withColumn("first", (F.col("pool") + upto - F.col("nb")).cast("int")).select("component", "label", "first", "nb"), "own")
    total = scratch.keep(pool.join(own.groupBy("component").agg(F.sum("nb").cast("int").alias("more")), "component", "left").select("component", "pool", (F.col("pool") + F.coalesce("more", F.lit(0))).alias("total")), "total")
    placed = near.join(total, "component").join(own, ["component", "label"], "left")
    spread = F.xxhash64("rep")
    block = F.when(F.col("nb").isNotNull(), F.col("first") + F.pmod(spread, F.greatest("nb", F.lit(1)))).otherwise(F.pmod(spread, F.greatest("pool", F.lit(1))))
    every = F.sequence(F.lit(0), F.col("total") - 1)
    others = F.when(F.col("nb").isNull(), every).otherwise(F.filter(every, lambda x: (x < F.col("first")) | (x >= F.col("first") + F.col("nb"))))
    return placed.select("component", "rep", "label", "sig", block.cast("int").alias("block"), others.alias("others"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, bucket_rows: int = BUCKET_ROWS, star_shingles: int = STAR_SHINGLES
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = scratch.keep(
        docs.mapInArrow(_described(shingle_words), "doc_id long, n long, print binary, sig binary"), "described"
    )
    named = described.filter("doc_id is not null and print is not null")
    classes = scratch.keep(
        named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    same_id = named.groupBy("doc_id").agg(F.count_distinct("print").alias("k")).filter("k > 1")

    chunks = chunk_count(percent)
    furthest = 2 * chunks - 1
    keys = classes.select("rep", "sig").mapInArrow(_keyed(chunks), "key long, rep long")
    met = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).filter("n > 1").select("key", "low"), "met")
    buckets = scratch.keep(keys.hint("merge").join(met, "key").select("key", "rep", "low"), "buckets")
    stars = _stars(buckets, classes, docs, shingle_words, percent, furthest, scratch, star_shingles)
    labels = scratch.keep(components(stars, scratch), "settled")
    ties = scratch.keep(_ties(buckets, classes, labels, furthest, scratch, bucket_rows), "ties")
    links = stars
    if not ties.isEmpty():
        near = scratch.keep(components(ties.unionByName(stars), scratch), "candidates")
        sized = near.join(classes.select("rep", "n", "sig"), F.col("node") == F.col("rep")).select("component", "rep", "n", "sig")
        placed = _blocks(scratch.keep(_labelled(sized, labels).select("component", "rep", "label", "n", "sig"), "near"), block_shingles, scratch)
        # Merged at any size: the side without texts grows with the input.
        texts = placed.hint("merge").join(docs, placed.rep == docs.doc_id).select("component", "rep", "label", "block", "others", "sig", "text")
        sets = texts.mapInArrow(_sets(shingle_words), "component long, rep long, label long, block int, others array<int>, sig binary, shingles binary")
        tasks = (
            _paired(sets, F.col("others"))
            .select("component", "bi", "bj", "block", "rep", "label", "sig", "shingles")
            .repartition("component", "bi", "bj")
            .sortWithinPartitions("component", "bi", "bj")
        )
        links = stars.unionByName(scratch.keep(tasks.mapInArrow(_linked(percent), "u long, v long"), "links"))
    within = (
        named.join(same_id, "doc_id").join(classes.select("print", "rep"), "print").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    )
    grouped = components(links.unionByName(within), scratch)
    found = classes.join(grouped, F.col("rep") == F.col("node"), "left").select(
        "print", F.coalesce("component", "rep").alias("component_id")
    )
    out = described.select("doc_id", "n", "print").join(scratch.keep(found, "found"), "print", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest doc_id, and rows without doc_id."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), one AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s
), flat AS (
  SELECT rep, n, unnest(s) AS g FROM one
), common AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT rep, rep FROM one
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
), component AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM shingled s LEFT JOIN one o ON len(s.s) > 0 AND o.s = s.s LEFT JOIN component c ON c.node = o.rep
"""
