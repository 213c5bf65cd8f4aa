"""Exact removal of repeated byte strings with a run-length index over a Burrows-Wheeler transform.

A byte is removed if a ``LENGTH``-byte string covering it also starts earlier (smaller doc_id, or earlier in the
same document). Strings never cross documents and are judged on the input.

Plan
----
1. Each document is scanned for anchors: the minima of hashed ``GRAM``-byte windows. Every string of LENGTH bytes
   contains an anchor, and equal strings contain the same anchor at the same offset, so only strings around anchors
   that occur twice can repeat. An anchor's surroundings (all strings that contain it) have a hash of their own.
2. Anchors are grouped by hash. Surroundings equal to earlier ones are covered whole, without looking at bytes;
   within a batch that is settled before the shuffle. Only the first of each, where an anchor has different
   surroundings, goes on. Anchors that a sample shows in very many surroundings, such as the edges of a passage that a third of all
   texts share, are grouped by hash and surroundings instead, so that none is a single task; the sample decides about routes only.
3. For those the bytes are fetched and, some megabytes at a time and all surroundings of an anchor together, a suffix
   order is built; its Burrows-Wheeler transform is kept as runs, with the text position, the preceding
   suffix and the match length sampled at each run's end. Matching statistics of every position stream from these
   samples: inside a run the match with the preceding suffix loses one byte a step. Chains of matches of LENGTH or
   more lead to one root for each repeated string, whose earliest start is kept.
4. An anchor with more different surroundings than fit one index (``HOT``), or routed apart, is settled by its strings' 128-bit
   hashes, in the same shuffle: a string's rows are made one per batch before it, and only the first stays.
5. Covered intervals meet their documents; bytes are cut and hashed.

Run-length compression makes equal text cheap in a Burrows-Wheeler transform: copies lengthen runs and add none. Step 2 is that
compression ahead of the shuffle: an index holds each different surrounding once, and the equal ones, known by 128 bits of hashes, follow
the one it holds.

Defined results: null and empty texts have no bytes; very long texts are scanned in overlapping pieces, whole. Rows without doc_id come
last. Rows that share a doc_id, or have none, are taken one after another in the order of their texts (a distributed sort);
identical rows thus count as copies. Other input columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, table

LENGTH = 100
GRAM = 32
INDEX_BYTES = 1 << 19
#: Different surroundings of one anchor that fit one index.
HOT = INDEX_BYTES // (2 * LENGTH - GRAM)
PIECE = 1 << 18
OUT_BYTES = 1 << 21
#: One text in so many is sampled for anchors of many surroundings; at most so many are routed apart, each seen so often in the sample.
SAMPLE, ROUTED, SEEN = 64, 4096, 4096
#: Surroundings, and strings of hot ones, that are held at a time.
FETCHED_ROWS, FETCHED_STRINGS = 1 << 15, 1 << 19
_LAST = 2**63 - 1

_U = np.uint64
_RNG = np.random.default_rng(9)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hash of any substring in constant time: sum of byte values times powers, modulo 2**64."""

    pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        if base not in self.pow or len(self.pow[base][0]) < n:
            size = max(n, PIECE + 4096)
            self.pow[base] = _powers(base, size), _powers(pow(base, -1, 2**64), size)
        power, self.inverse = self.pow[base]
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: n - 1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in concatenated pieces that end at ``ends``; their hashes."""
    wide = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    gram = Rolling(data, _BASE).grams(GRAM) | _U(1)
    low = _sliding(gram, wide, np.minimum)
    starts = np.concatenate([[0], ends[:-1]])
    stop = np.repeat(ends, ends - starts)[: len(low)]
    low[np.arange(len(low)) + LENGTH > stop] = 0
    pad = np.zeros(wide - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), wide, np.maximum)[: len(gram)]
    at = np.flatnonzero(best == gram)
    return at, gram[at]


def _pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Chunks of (row, from, to, first, last): bytes to look at, and where anchors count. Long texts overlap."""
    chunk, size, margin = [], 0, 2 * LENGTH
    for row in range(len(offsets) - 1):
        n = int(offsets[row + 1] - offsets[row])
        if n < LENGTH:
            continue
        for first in range(0, n, PIECE):
            last = min(n, first + PIECE)
            lo, hi = max(0, first - margin), min(n, last + margin)
            if size and size + hi - lo > PIECE:
                yield chunk
                chunk, size = [], 0
            chunk.append((row, lo, hi, first, last))
            size += hi - lo
    if chunk:
        yield chunk


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def _scanner(routed: np.ndarray):
    """``_scan`` with sorted hashes of anchors that are routed apart."""
    return lambda batches: _scan(batches, routed)


def _scan(batches: Iterator[pa.RecordBatch], routed: np.ndarray = np.empty(0, dtype=np.int64)) -> Iterator[pa.RecordBatch]:
    """(d, e, data) to anchors (h, w, d, e, pos, later, apart): later if an earlier equal one in the batch settles it.

    Those need no company, so they get a hash that scatters them. Anchors that are routed apart get one made of theirs and
    of their surroundings'.
    """
    reach = LENGTH - GRAM
    for batch in batches:
        doc, nth = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = _bytes(batch.column(2))
        found = []
        for chunk in _pieces(offsets):
            row, lo, hi, first, last = np.array(chunk, dtype=np.int64).T
            begin = offsets[row] + lo
            text = np.concatenate([data[a : a + n] for a, n in zip(begin.tolist(), (hi - lo).tolist(), strict=True)])
            ends = np.cumsum(hi - lo)
            at, h = anchors(text, ends)
            k = np.searchsorted(ends, at, "right")
            own = at - (ends[k] - (hi - lo)[k]) + lo[k]
            counts = (own >= first[k]) & (own < last[k])
            at, h, k, own = at[counts], h[counts], k[counts], own[counts]
            left = np.maximum(at - reach, ends[k] - (hi - lo)[k])
            right = np.minimum(at + LENGTH, ends[k])
            w = _mixed(Rolling(text, _BASE2).of(left, right) + (at - left).astype(np.uint64) * _U(_BASE) + (right - at).astype(np.uint64))
            found.append((h.view(np.int64), w.view(np.int64), row[k], own))
        if not found:
            continue
        h, w, row, own = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((own, nth[row], doc[row], w, h))
        h, w, d, e, pos = h[order], w[order], doc[row][order], nth[row][order], own[order]
        later = np.zeros(len(h), dtype=bool)
        later[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        apart = routed[np.minimum(np.searchsorted(routed, h), len(routed) - 1)] == h if len(routed) else np.zeros(len(h), dtype=bool)
        h = np.where(apart, _mixed(h.view(np.uint64) * _U(_BASE) + w.view(np.uint64)).view(np.int64), h)
        h = np.where(later, _mixed(h.view(np.uint64) + _mixed(((d * 31 + e) * 31 + pos).view(np.uint64))).view(np.int64), h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(w), pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(pos, pa.int64()), pa.array(later), pa.array(apart)],
            names=["h", "w", "d", "e", "pos", "later", "apart"],
        )


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling that only sorts what is still tied; and each position's next seven symbols."""
    n = len(text)
    wide = np.zeros(n + 7, dtype=np.int16)
    wide[:n] = text
    packed = np.zeros(n, dtype=np.int64)
    for k in range(7):
        packed <<= 9
        packed |= wide[k : k + n]
    sa = np.argsort(packed).astype(np.int32)
    key, slots = packed[sa], np.arange(n, dtype=np.int32)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, slots, np.int32(0)))
    del key, slots
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = start
    step = 7
    while True:
        idx = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(idx):
            return sa, packed
        at = sa[idx]
        then = at + step
        key = start[idx].astype(np.int64) * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[idx] = at
        fresh = np.ones(len(idx), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[idx] = fresh
        start[idx] = rank[at] = np.maximum.accumulate(np.where(fresh, idx, 0))
        step *= 2


class RunIndex:
    """Burrows-Wheeler runs of a text with samples at their ends: position, preceding suffix, match length."""

    def __init__(self, text: np.ndarray):
        sa, packed = suffix_order(text)
        self.n = n = len(text)
        before = np.where(sa > 0, text[np.maximum(sa - 1, 0)].astype(np.int32), -1)
        head = np.ones(n, dtype=bool)
        head[1:] = before[1:] != before[:-1]
        slots = np.flatnonzero(head)
        at = sa[slots]
        previous = np.where(slots > 0, sa[np.maximum(slots - 1, 0)], -1)
        order = np.argsort(at)
        self.at, self.previous = at[order], previous[order]
        self.length = self._matches(self.at, self.previous, packed)

    def _matches(self, a: np.ndarray, b: np.ndarray, packed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < self.n
            live, x, y = live[inside], x[inside], y[inside]
            apart = packed[x] ^ packed[y]
            same = np.zeros(len(live), dtype=np.int64)
            for k in range(7):
                same += (apart >> (9 * (6 - k))) == 0
            out[live] += np.minimum(same, self.n - np.maximum(x, y))
            live = live[same == 7]
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, the match with the preceding suffix: its length and where that suffix starts."""
        gone = np.diff(np.append(self.at, self.n))
        since = np.arange(self.n, dtype=np.int32) - np.repeat(self.at.astype(np.int32), gone)
        return np.repeat(self.length.astype(np.int32), gone) - since, np.repeat(self.previous.astype(np.int32), gone) + since


def repeated_starts(windows: list[bytes], order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the concatenated windows (each followed by one separator) an earlier string starts again.

    ``order`` ranks each window's document, ``starts`` is its place there.
    """
    size = np.array([len(w) for w in windows], dtype=np.int64)
    text = np.zeros(int(size.sum()) + len(windows), dtype=np.int16)
    ends = np.cumsum(size + 1) - 1
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(windows), dtype=np.uint8).astype(np.int16) + 1
    length, previous = RunIndex(text).statistics()
    begin = ends - size
    places = np.arange(len(text), dtype=np.int32)
    valid = places + LENGTH <= np.repeat(ends.astype(np.int32), size + 1)
    key = np.repeat((order << 38) + starts - begin, size + 1) + places
    long = (length >= LENGTH) & valid
    root = np.where(long, previous, places)
    live = np.flatnonzero(long)
    del length, previous, places, text
    while True:
        further = root[root[live]]
        if (further == root[live]).all():
            break
        root[live] = further
    first = key.copy()
    np.minimum.at(first, root[live], key[live])
    again = np.zeros(len(key), dtype=bool)
    again[live] = key[live] > first[root[live]]
    again[root[live]] |= key[root[live]] > first[root[live]]
    return again, begin


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, s, d, e, start, later, window) to covered (d, e, lo, hi).

    Rows with a window go to an index, together with all of their anchor. Rows without are single strings known by
    their hash (h, s): all but the first of a hash are covered.
    """

    def covered(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["d", "e", "lo", "hi"])

    def flush(rows: list) -> pa.RecordBatch:
        d, e, start = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
        by = np.lexsort((e, d))
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[by][1:] != d[by][:-1]) | (e[by][1:] != e[by][:-1])
        order = np.empty(len(d), dtype=np.int64)
        order[by] = np.cumsum(new) - 1
        marked, begin = repeated_starts([r[4] for r in rows], order, start)
        a, b = _runs(marked)
        k = np.searchsorted(begin, a, "right") - 1
        lo = start[k] + a - begin[k]
        return covered(d[k], e[k], lo, lo + (b - a) + LENGTH - 1)

    rows, size, last = [], 0, (None, None, None, None, None)
    for batch in batches:
        single = batch.filter(pc.is_null(batch.column(6)))
        if single.num_rows:
            h, s, d, e, start, later = (single.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            same = np.zeros(len(h), dtype=bool)
            same[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
            # The first start of a hash may come several times, from overlapping surroundings.
            firsts = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            known = firsts == 0 if (h[0], s[0]) == last[:2] else np.zeros(len(h), dtype=bool)
            d1, e1, s1 = (np.where(known, last[k] or 0, x[firsts]) for k, x in ((2, d), (3, e), (4, start)))
            again = ((d != d1) | (e != e1) | (start != s1)) | later
            last = (h[-1], s[-1], d1[-1], e1[-1], s1[-1])
            yield covered(d[again], e[again], start[again], start[again] + LENGTH)
        for row in zip(*(batch.filter(pc.is_valid(batch.column(6))).column(k).to_pylist() for k in (0, 2, 3, 4, 6)), strict=True):
            if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                yield flush(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield flush(rows)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, e, packed, asked) to surroundings (h, s, d, e, start, later, window) of each asked (pos, h, hot).

    Surroundings of hot anchors are given as hashes of their strings, each once of those held at a time: those that come later
    among them are settled and need no company.
    """
    reach = LENGTH - GRAM
    unpack = zstandard.ZstdDecompressor().decompress

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        h, d, e, start, window = zip(*rows, strict=True)
        n = len(rows)
        return _row_batch(pa.array(h, pa.int64()), pa.array([0] * n, pa.int64()), d, e, start, np.zeros(n, dtype=bool), pa.array(window, pa.binary()))

    def hashed(strings: list[tuple]) -> pa.RecordBatch:
        s1, s2, d, e, start = (np.concatenate(x) for x in zip(*strings, strict=True))
        order = np.lexsort((start, e, d, s2, s1))
        s1, s2, d, e, start = (x[order] for x in (s1, s2, d, e, start))
        later = np.zeros(len(s1), dtype=bool)
        later[1:] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
        # A string repeated at one place only because surroundings overlap is not a repeat.
        same = np.zeros(len(d), dtype=bool)
        same[1:] = later[1:] & (d[1:] == d[:-1]) & (e[1:] == e[:-1]) & (start[1:] == start[:-1])
        s1 = np.where(later, _mixed(((d * 31 + e) * 31 + start).view(np.uint64) + s1.view(np.uint64)).view(np.int64), s1)
        s1, s2, d, e, start, later = (x[~same] for x in (s1, s2, d, e, start, later))
        return _row_batch(pa.array(s1), pa.array(s2), d, e, start, later, pa.nulls(len(d), pa.binary()))

    for batch in batches:
        rows, strings, n = [], [], 0
        for k in range(batch.num_rows):
            d, e, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), unpack(batch.column(2)[k].as_py())
            for one in batch.column(3)[k].as_py():
                at = one["pos"]
                lo = max(0, at - reach)
                if one["hot"]:
                    text = np.frombuffer(data[lo : at + LENGTH], dtype=np.uint8)
                    m = len(text) - LENGTH + 1
                    s1, s2 = (Rolling(text, base).grams(LENGTH).view(np.int64) for base in (_BASE, _BASE2))
                    strings.append((s1, s2, np.full(m, d, dtype=np.int64), np.full(m, e, dtype=np.int64), lo + np.arange(m)))
                    n += m
                else:
                    rows.append((one["h"], d, e, lo, data[lo : at + LENGTH]))
                if n >= FETCHED_STRINGS:
                    yield hashed(strings)
                    strings, n = [], 0
                if len(rows) >= FETCHED_ROWS:
                    yield whole(rows)
                    rows = []
        if rows:
            yield whole(rows)
        if strings:
            yield hashed(strings)


def _row_batch(h: pa.Array, s: pa.Array, d, e, start, later, window: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [h, s, pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(start, pa.int64()), pa.array(later, pa.bool_()), window],
        names=["h", "s", "d", "e", "start", "later", "w"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffles."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([pack(x.as_py()) for x in batch.column(3)], pa.binary())],
            names=["doc_id", "d", "e", "packed"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed, covered) to the removed spans and the remaining bytes, a few megabytes at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    span = pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))

    def rows(ids, sizes, spans, left):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    for batch in batches:
        ids, sizes, spans, left, held = [], [], [], [], 0
        covered = batch.column(2)
        for k in range(batch.num_rows):
            text = np.frombuffer(unpack(batch.column(1)[k].as_py()), dtype=np.uint8)
            kept, gone = cut(text, covered[k].values if covered[k].is_valid else None)
            ids.append(batch.column(0)[k].as_py())
            sizes.append(len(text))
            spans.append([{"at": a, "to": b} for a, b in gone])
            left.append(b"".join(x.tobytes() for x in kept))
            held += len(left[-1])
            if held > OUT_BYTES:
                yield rows(ids, sizes, spans, left)
                ids, sizes, spans, left, held = [], [], [], [], 0
        yield rows(ids, sizes, spans, left)


def cut(text: np.ndarray, covered) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """What is left of ``text`` without the covered intervals, and the maximal runs that go."""
    if covered is None or not len(covered):
        return [text], []
    lo, hi = covered.field(0).to_numpy(zero_copy_only=False), covered.field(1).to_numpy(zero_copy_only=False)
    order = np.argsort(lo)
    lo, hi = lo[order], np.minimum(np.maximum.accumulate(hi[order]), len(text))
    first = np.ones(len(lo), dtype=bool)
    first[1:] = lo[1:] > hi[:-1]
    a = lo[first]
    b = hi[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]
    edges = zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)
    return [text[x:y] for x, y in edges], list(zip(a.tolist(), b.tolist(), strict=True))


_ANCHORS = "h long, w long, d long, e long, pos long, later boolean, apart boolean"


def crowded(docs: DataFrame, sample: int = SAMPLE, seen: int = SEEN) -> np.ndarray:
    """Sorted hashes of the anchors that a sample of ``docs(d, e, data)`` shows in the most different surroundings."""
    some = docs.filter(F.pmod(F.xxhash64("d", "e"), F.lit(sample)) == 0).mapInArrow(_scan, _ANCHORS)
    counts = some.filter("not later").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)
    return np.array(sorted(r.h for r in counts.orderBy(F.desc("n"), "h").limit(ROUTED).collect()), dtype=np.int64)


def covered_intervals(docs: DataFrame, packed: DataFrame, scratch: Scratch, hot: int = HOT, routed: np.ndarray | None = None) -> DataFrame:
    """``(d, e, lo, hi)``: repeated bytes of ``docs(d, e, data)``, whose order is that of (d, e).

    ``packed(d, e, packed)`` has the same texts compressed.
    """
    ranked = (
        docs.mapInArrow(_scanner(crowded(docs) if routed is None else routed), _ANCHORS)
        .repartition("h")
        .withColumn("nth", F.row_number().over(Window.partitionBy("h", "w").orderBy("d", "e", "pos")))
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("h")))
        .withColumn("covered", F.expr("later or nth > 1"))
        .filter("covered or apart or kinds > 1")
    )
    h = F.when(~F.col("covered"), F.col("h")).alias("h")
    seen = scratch.keep(ranked.select("d", "e", "pos", h, "covered", F.expr(f"apart or kinds > {hot}").alias("hot")), "anchors")
    asked = seen.filter("not covered").groupBy("d", "e").agg(F.collect_list(F.struct("pos", "h", "hot")).alias("asked"))
    indexed = scratch.keep(
        packed.join(asked.hint("merge"), ["d", "e"])
        .select("d", "e", "packed", "asked")
        .mapInArrow(_fetched, "h long, s long, d long, e long, start long, later boolean, w binary")
        .repartition("h")
        .sortWithinPartitions("h", "s", "d", "e", "start")
        .mapInArrow(_indexed, "d long, e long, lo long, hi long"),
        "indexed",
    )
    back = F.least(F.lit(LENGTH - GRAM), F.col("pos"))
    whole = seen.filter("covered").select("d", "e", (F.col("pos") - back).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))
    return whole.unionByName(indexed)


def _ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(d, data, ..)`` with ``e``, which numbers those that share d in the order of their data; 0 where d is unique.

    Shared ones are sorted by ranges, equal ones spread by a random number: no task has all rows without doc_id, or all equal ones.
    """
    shared = scratch.keep(rows.groupBy("d").agg(F.count("*").alias("k")).filter("k > 1").select("d"), "shared")
    if shared.isEmpty():
        return rows.withColumn("e", F.lit(0).cast("long"))
    some = rows.join(shared, "d").withColumn("salt", F.rand(7)).orderBy("d", "data", "salt")
    some = some.withColumn("e", F.monotonically_increasing_id()).select(*rows.columns, "e")
    single = rows.join(shared, "d", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("e"))
    return scratch.keep(some, "ordered").unionByName(scratch.keep(single, "single"))


def without_repeats(docs: DataFrame, hot: int = HOT, routed: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` per row of ``docs(doc_id, text)``: removed spans (at, to) in bytes, end exclusive, and the bytes left.

    A span may begin or end within a character of several bytes, so what is left is binary.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("data"),
    )
    rows = _ordered(rows, scratch)
    packed = rows.select("doc_id", "d", "e", "data").mapInArrow(_packed, "doc_id long, d long, e long, packed binary")
    covered = covered_intervals(rows.select("d", "e", "data"), packed.select("d", "e", "packed"), scratch, hot, routed)
    per_doc = covered.groupBy("d", "e").agg(F.collect_list(F.struct("lo", "hi")).alias("covered"))
    return (
        packed.join(per_doc.hint("merge"), ["d", "e"], "left")
        .select("doc_id", "packed", "covered")
        .mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<at:long,to:long>>, kept binary")
    )


def remove_repeats(docs: DataFrame, hot: int = HOT, routed: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row: the digest of ``without_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["at"])
    return without_repeats(docs, hot, routed).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN substring(h, 2 * i + 1, 200) END AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)
), r AS (
  SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM p
), c AS (
  SELECT doc_id, i, byte, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r
), e AS (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM c
), a AS (
  SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
    string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept
  FROM e GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
