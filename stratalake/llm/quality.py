"""Operator 7: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features of a text, hashed into ``2**BITS`` slots:

* word unigrams and bigrams, case kept;
* unigrams and bigrams of word shapes (runs of capitals, small letters,
  digits and each other character), which unseen words share;
* a bigram of a word with itself, under one name for all words.

Counts are dampened (log), then scaled to length 1, so texts of any length
score alike; empty and null texts have the bias alone.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS``, the rows
with the smallest hash of doc_id) and runs on the driver; weights take a fixed
4 MB and are broadcast.  Scoring is a sparse dot product a text.  Whole texts
become features on the executors, so the driver gets slots and values of sampled
rows alone, ``2**BITS`` a row at most.

Rows are scored one by one: equal texts score alike, and repeated rows and ids
stay as often as they occur.  A doc_id with several labels has the largest; of
rows that share a labelled doc_id the one with the smallest text is learned
from.  Rows without doc_id are never learned from; texts of any length count whole.
Other columns, whatever their names, stay as they are.  Without labelled rows
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import HASHES, LONG_WORD, ngrams, own_column, prepare, scramble, words_of

BITS = 20
#: The most labelled rows that training reads.
TRAIN_ROWS = 6000
EPOCHS = 4
_UPPER, _LOWER, _DIGIT = re.compile(rb"(?:[A-Z]|\xc3[\x80-\x9e])+"), re.compile(rb"(?:[a-z]|[\xc3-\xf4][\x80-\xbf]+)+"), re.compile(rb"[0-9]+")


class Shapes(dict):
    """word -> 64-bit hash of its shape; bounded, for long words aren't kept."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        shape = _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
        s = HASHES[b"\x00shape " + shape]
        if len(word) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = s
        return s


_SHAPES = Shapes()


def features(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; values have length 1."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    h = HASHES.array(words)
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    same = np.full(int((h[1:] == h[:-1]).sum()), np.uint64(0x5EED))
    keys = np.concatenate([scramble(h), ngrams(h, 2), scramble(s + np.uint64(1)), ngrams(s, 2), same])
    slots, counts = np.unique((keys >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    return slots, values / np.sqrt((values * values).sum())


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss, one row at a time."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


Row = tuple[np.ndarray, np.ndarray, int]


def train(sample: list[Row], epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, from (slots, values, label) rows."""
    size = 1 << BITS
    rows = [(np.append(slots, np.int32(size)), np.append(values, np.float32(1)), label) for slots, values, label in sample]
    model, order = Ftrl(size + 1), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights().astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, label: str = "quality") -> list[Row]:
    """Features and labels of at most ``limit`` labelled rows outside the held-out fifth, by hash of doc_id; in order of doc_id."""
    prepare(docs.sparkSession)
    mark = own_column(docs, "label_of_row")
    chosen = (
        labels.select("doc_id", F.col(label).alias(mark)).filter(F.col(mark).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(mark).alias(mark))
        .filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(mark).cast("int").alias("label"))

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([s.astype(np.int32) for s, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(2)], ["doc_id", "slots", "values", "label"])

    got = rows.mapInArrow(run, "doc_id long, slots array<int>, values array<float>, label int").toArrow()
    order, (slots, values) = np.argsort(got.column("doc_id").to_numpy()), (got.column(c).combine_chunks() for c in ("slots", "values"))
    starts, flat_slots, flat_values, y = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy(), got.column("label").to_numpy()
    return [(flat_slots[a:b], flat_values[a:b], int(y[k])) for k in order.tolist() for a, b in [starts[k : k + 2]]]  # views: no object a feature


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> np.ndarray:
    return train(training_sample(docs, labels, limit))


def score(docs: DataFrame, weights: np.ndarray, *keep: str, text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score in 0..1."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*keep, F.col(text).cast("binary").alias(own_column(docs, "bytes_of_text")))
    schema = docs.select(*keep).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        w = held.value
        for b in batches:
            out = np.empty(b.num_rows)
            for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                slots, values = features(t)
                out[k] = 1 / (1 + np.exp(-np.clip(float(w[slots] @ values) + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    columns, name = docs.columns, own_column(docs, "score")
    return score(docs, weights, *columns, name=name).filter(F.col(name) >= threshold).drop(name)
