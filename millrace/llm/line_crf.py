"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line's score comes from its own features and those of the lines before and after; a transition matrix ties
neighbouring labels. Marginals come from forward-backward; a document's quality is their mean, weighted by line length.

Training: lines inherit their document's label; the log-likelihood is maximised by full gradients on ``sample`` labelled documents
chosen by a hash of doc_id, with all of their lines. Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from. Scoring
reads every line of every text; features are counts of byte classes, made for many lines at a time. Forward-backward cuts chains
into blocks that run in step: first each block's product of transitions, then the states at block ends, then the states inside, so that
a very long text takes few steps too.

Defined results: null and empty texts are one empty line and get its score; very long texts are scored and learned from whole. Rows
without doc_id are not held out and are scored; rows that repeat are scored alike, and a repeated doc_id is learned from once, with the
text that sorts first. Labels without doc_id or quality are left out; of several for a document the larger
counts; without any, every score is 0.5. A line's label is good from a chance of 0.5 on. Other columns, whatever their names, are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, table

#: Labelled documents learned from: the documented bound of the fit.
SAMPLE = 3000
STEPS = 200
RUN = 64
CHUNK = 1 << 20
_NAMES = 11
_CLASS = np.full(256, 8, dtype=np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", ".,;:'\"-", "!?", "|", "#*$%&<>=_~^@\\")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xC0:] = 9
_CLASS[0x80:0xC0] = 10
FEATURES = 26
_BYTE_HASH = np.random.default_rng(7).integers(1, 2**62, 256, dtype=np.int64)


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of concatenated texts, and each text's number of lines (1 if empty)."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets))
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break at a text's end starts an empty line at the next text's start; both belong, in this order.
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    return starts, ends, per_text + 1


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the lines' lengths in characters."""
    n, size = len(starts), ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    body = data[at]
    kind = _CLASS[body].astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * _NAMES + kind, minlength=n * _NAMES).reshape(n, _NAMES).astype(np.float64)
    first = np.ones(len(body), dtype=bool)
    first[1:] = (kind[:-1] == 3) | (owner[1:] != owner[:-1])
    words = np.bincount(owner, weights=first & (kind != 3), minlength=n)
    chars = size - counts[:, 10]
    ratio = counts / np.maximum(chars, 1)[:, None]
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    head = np.where(size > 0, data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
    f = np.zeros((n, FEATURES))
    f[:, 0] = 1
    f[:, 1:11] = ratio[:, :10]
    f[:, 11] = np.log1p(chars) / 5
    f[:, 12] = np.log1p(words) / 4
    f[:, 13] = np.minimum((chars - counts[:, 3]) / np.maximum(words, 1), 30) / 10
    f[:, 14] = np.isin(last, [ord(c) for c in ".!?"])
    f[:, 15] = _CLASS[head] == 1
    f[:, 16] = chars == 0
    f[:, 17] = ratio[:, 1] > 0.3
    f[:, 18] = ratio[:, 7] > 0.05
    f[:, 19] = ratio[:, 6] > 0.02
    f[:, 20] = ratio[:, 5] > 0.03
    f[:, 21] = ratio[:, 2] > 0.1
    f[:, 22] = words < 5
    f[:, 23] = ratio[:, 4] > 0.08
    again = _repeats(body, owner, first & (kind != 3), kind != 3, n) / np.maximum(words, 1)
    f[:, 24] = again
    f[:, 25] = again > 0.3
    return f, chars


def _repeats(body: np.ndarray, owner: np.ndarray, begins: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """For each of n lines, its words equal to the word before."""
    at = np.flatnonzero(begins)
    if len(at) < 2:
        return np.zeros(n)
    word = np.cumsum(begins) - 1
    place = np.arange(len(body)) - at[np.maximum(word, 0)]
    value = np.where(inside, _BYTE_HASH[body] * (2 * place + 1), 0)
    h = np.add.reduceat(value, at)
    same = (h[1:] == h[:-1]) & (owner[at[1:]] == owner[at[:-1]])
    return np.bincount(owner[at[1:]][same], minlength=n).astype(np.float64)


def with_neighbours(f: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, then the previous line's, then the next line's; zeros beyond a text's ends."""
    out = np.zeros((len(f), 3 * FEATURES))
    out[:, :FEATURES] = f
    ends = np.cumsum(per_text)
    inner = np.ones(len(f), dtype=bool)
    inner[ends - per_text] = False
    at = np.flatnonzero(inner)
    out[at, FEATURES : 2 * FEATURES] = f[at - 1]
    out[at - 1, 2 * FEATURES :] = f[at]
    return out


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray

    def odds(self, f: np.ndarray) -> np.ndarray:
        return np.clip(f @ self.weights, -30, 30)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector or matrix divided by its sum."""
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _runs(per_text: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most ``run`` lines of each text: first line, length, and number in its text."""
    blocks = -(-per_text // run)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(per_text) - per_text, blocks) + nth * run
    return start, np.minimum(np.repeat(per_text, blocks) - nth * run, run), nth


def _longest_first(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by length, and how many have a line at each step."""
    order = np.argsort(-length, kind="stable")
    return order, np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")


def marginals(odds: np.ndarray, per_text: np.ndarray, transition: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Chance of 'good' for each line; summed chances of label pairs (2, 2)."""
    n, move = len(odds), np.exp(transition)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    #: step[t] takes the state before line t to the one after it; a text's first line has no move.
    step = np.broadcast_to(move, (n, 2, 2)).copy()
    step[np.cumsum(per_text) - per_text] = np.eye(2)
    step[:, :, 1] *= np.exp(odds)[:, None]
    start, length, nth = _runs(per_text, run)
    order, active = _longest_first(length)
    first, last = start[order], (start + length)[order] - 1
    whole = np.broadcast_to(np.eye(2), (len(order), 2, 2)).copy()
    for t, k in enumerate(active):
        whole[:k] = _scaled(whole[:k] @ step[first[:k] + t])
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    # States at the ends of blocks, along each text: block b of all texts at a time.
    entry, leave = np.full((len(order), 2), 0.5), np.full((len(order), 2), 0.5)
    blocks = np.flatnonzero(np.append(nth[1:] == 0, True)) - np.flatnonzero(nth == 0) + 1
    by_text, many = _longest_first(blocks)
    head = (np.cumsum(blocks) - blocks)[by_text]
    for b, k in enumerate(many[1:], 1):
        here, before = at[head[:k] + b], at[head[:k] + b - 1]
        entry[here] = _scaled((entry[before][:, None, :] @ whole[before])[:, 0])
    for b in range(len(many) - 2, -1, -1):
        k = many[b + 1]
        here, after = at[head[:k] + b], at[head[:k] + b + 1]
        leave[here] = _scaled((whole[after] @ leave[after][:, :, None])[:, :, 0])
    ahead, behind = np.empty((n, 2)), np.empty((n, 2))
    state = entry.copy()
    for t, k in enumerate(active):
        state[:k] = ahead[first[:k] + t] = _scaled((state[:k, None, :] @ step[first[:k] + t])[:, 0])
    state = leave.copy()
    for t in range(len(active)):
        k = active[t]
        line = last[:k] - t
        behind[line] = state[:k]
        state[:k] = _scaled((step[line] @ state[:k, :, None])[:, :, 0])
    joint = ahead * behind
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(per_text) - per_text] = False
    now = np.flatnonzero(inner)
    both = _scaled(ahead[now - 1][:, :, None] * step[now] * behind[now][:, None, :])
    return joint[:, 1] / joint.sum(axis=1), both.sum(axis=0)


def _text_parts(per_text: np.ndarray, lines: int = 1 << 18) -> list[tuple[int, int, np.ndarray]]:
    """Ranges of lines of whole texts, some lines at a time: (from, to, lines per text)."""
    ends, out, row = np.cumsum(per_text), [], 0
    while row < len(per_text):
        begin = int(ends[row] - per_text[row])
        to = max(row + 1, int(np.searchsorted(ends, begin + lines, "right")))
        out.append((begin, int(ends[to - 1]), per_text[row:to]))
        row = to
    return out


def train(f: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = 1e-4) -> Model:
    """Gradient ascent (Adam) on the chains' mean log-likelihood; every document counts the same.

    ``f`` has the lines' own features; neighbours are added for some texts at a time.
    """
    if not len(labels):
        return Model(np.zeros(3 * FEATURES), np.zeros((2, 2)))
    y = np.repeat(labels, per_text).astype(np.float64)
    share = np.repeat(1 / per_text, per_text)
    model = Model(np.zeros(3 * FEATURES), np.zeros((2, 2)))
    parts = _text_parts(per_text)
    moves = per_text - 1
    same = np.array([[moves[labels == 0].sum(), 0], [0, moves[labels == 1].sum()]], dtype=np.float64)
    m = v = 0.0
    for step in range(1, steps + 1):
        odds = np.concatenate([model.odds(with_neighbours(f[a:b], lines)) for a, b, lines in parts])
        chance, pairs = marginals(odds, per_text, model.transition)
        pull = share * (y - chance)
        up = sum(with_neighbours(f[a:b], lines).T @ pull[a:b] for a, b, lines in parts)
        g = np.concatenate([up / len(labels) - penalty * model.weights, ((same - pairs) / max(1, moves.sum())).ravel() - 0.01 * model.transition.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[:-4]
        model.transition = np.clip(model.transition + move[-4:].reshape(2, 2), -2, 2)
    return model


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def _parts_of(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last, lines per text, chances of good, weights), a megabyte of texts at a time."""
    data, offsets = _texts(column)
    row = 0
    while row < len(column):
        to = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1))
        part = data[offsets[row] : offsets[to]]
        starts, ends, per_text = line_table(part, offsets[row : to + 1] - offsets[row])
        f, chars = line_features(part, starts, ends)
        odds = np.concatenate([model.odds(with_neighbours(f[a:b], lines)) for a, b, lines in _text_parts(per_text)])
        yield row, to, per_text, marginals(odds, per_text, model.transition)[0], np.maximum(chars, 1)
        row = to


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """A score for each text: its lines' chances of being good, weighted by length."""
    out = np.empty(len(column))
    for row, to, per_text, chance, weight in _parts_of(column, model):
        text = np.repeat(np.arange(to - row), per_text)
        out[row:to] = np.bincount(text, weights=weight * chance) / np.bincount(text, weights=weight)
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, quality) to the features of all its lines."""
    for batch in batches:
        data, offsets = _texts(batch.column(0))
        for k in range(batch.num_rows):
            part = data[offsets[k] : offsets[k + 1]]
            starts, ends, _ = line_table(part, np.array([0, len(part)]))
            f = line_features(part, starts, ends)[0].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary()), batch.column(1).slice(k, 1)], names=["f", "quality"])


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents that are not held out, each once and whole."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .filter("id is not null and quality is not null")
        .filter(_remainder(F.col("id")) != 1)
        .groupBy("id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    once = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    rows = once.select("text", "quality").mapInArrow(_featured, "f binary, quality int").collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.f)))
    f = [np.frombuffer(r.f, dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    quality, per_text = np.array([int(r.quality > 0) for r in rows]), np.array([len(x) for x in f], dtype=np.int64)
    del rows
    return train(np.concatenate(f) if f else np.empty((0, FEATURES), np.float32), per_text, quality)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, line, good, label)`` per line of each row: its number from 0, its chance of being good, and its label, good or bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, per_text, chance, _ in _parts_of(batch.column(1), model):
                owner = pa.array(np.repeat(np.arange(row, to), per_text))
                line = np.arange(len(chance)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                label = np.where(chance >= 0.5, "good", "bad")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(line), pa.array(chance), pa.array(label)], names=["doc_id", "line", "good", "label"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, line long, good double, label string"
    )


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, in one pass over the rows."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(place).cast(pa.binary()), model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
