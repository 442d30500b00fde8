"""Operator 12: periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words of one document with smallest period
``q`` (words ``q`` apart are identical) and a length of at least
``max(least, 2 * q)`` that no neighbouring word extends keeping the period.

1. Naming.  Level 0 names the words; level k + 1 names blocks of ``2**(k+1)``
   words by the pair of names of their halves.  Equal names mean equal blocks of
   one document: names are ranks of exact pairs, so nothing is hashed and no
   suffixes are sorted.  A block that occurs once is named 0, which equals nothing;
   the levels end where no block occurs twice.
2. Candidates.  A run of period q in ``[2**k, 2**(k+1))`` holds, on any grid of
   step ``2**(k-1)``, a place whose block of ``2**(k-1)`` words occurs again q words
   later (for short periods a grid and level that follow from ``least``).  So each
   place of the grid meets the places with its name at those distances: at most
   ``2**k`` for each of ``n / 2**(k-1)`` places, O(n log n) altogether.
3. Extension.  The longest common extension of both places is taken by descending
   levels, forward and backward; the stretch is kept if it is long enough.  Of equal
   stretches the smallest period stays, which is the smallest there is.

All steps are whole-array numpy over a few megabytes of texts at a time, a scan
without shuffle.  Memory is about 4 bytes a word and level besides the words of
a portion; a text longer than a portion is a portion of its own and taken whole.

Null and empty texts have no words and no runs.  Rows are treated one by one, so
repeated rows and ids, null ids too, stay as often as they occur; columns other
than doc_id and text aren't read, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import portions, prepare, words_of

#: Words that a run has at least.
LEAST = 12
#: Candidates that are extended at a time.
AT_ONCE = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... of keys that occur twice or more, 0 for the others."""
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    return np.where(again, np.cumsum(again), 0).astype(np.int32)[where]


class Names:
    """Names of the blocks of ``2**k`` words that start at each place; one place more than there are words."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        """``words``: numbers of the words of all documents, one after another; ``doc``: their document."""
        self.n = n = len(words)
        self.levels = [np.zeros(n + 1, np.int32)]
        if n:
            self.levels[0][:n] = _ranks(doc.astype(np.int64) * (int(words.max()) + 1) + words)
        while True:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            at = np.flatnonzero((last[: n - half] > 0) & (last[half:n] > 0)) if n > half else np.empty(0, np.int64)
            # A block across two documents is the only one with that change at that place, so it is named 0.
            names = _ranks(last[at].astype(np.int64) << 32 | last[at + half]) if len(at) else at
            if not names.any():
                return
            self.levels.append(np.zeros(n + 1, np.int32))
            self.levels[-1][at] = names

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from places i and j on."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = self.levels[k][i + out], self.levels[k][j + out]
            out += ((a == b) & (a > 0)).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal before places i < j."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            back = i - out - (1 << k)
            a, b = self.levels[k][np.maximum(back, 0)], self.levels[k][np.maximum(j - out - (1 << k), 0)]
            out += ((a == b) & (a > 0) & (back >= 0)).astype(np.int64) << k
        return out


def _grids(least: int) -> Iterator[tuple[int, int, int, int]]:
    """(smallest period, end of periods, level, step) of each class of periods."""
    reach = -(-least // 2)  # words that are equal one period on, from a run's start, at least
    level = reach.bit_length() - 1
    if level and reach == 1 << level:
        level -= 1
    yield 1, 2 << level, level, reach - (1 << level) + 1
    k = level + 1
    while True:
        yield 1 << k, 2 << k, k - 1, 1 << k - 1
        k += 1


def _candidates(names: Names, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places i < j with equal blocks, j - i a possible period; at most about ``AT_ONCE`` together."""
    for low, end, level, step in _grids(least):
        if level >= len(names.levels) or low > names.n:
            return
        held = names.levels[level]
        places = np.flatnonzero(held)
        keys = np.sort(held[places].astype(np.int64) * (names.n + 1) + places)  # by name, then place
        grid = places[places % step == 0]
        own = held[grid].astype(np.int64) * (names.n + 1)
        last = own + names.n
        first = np.searchsorted(keys, own + grid + low)
        count = np.searchsorted(keys, np.minimum(own + grid + end, last)) - first
        some = count > 0
        grid, first, count, own = grid[some], first[some], count[some], own[some]
        ends = np.cumsum(count)
        at = 0
        while at < len(grid):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            c = count[at:to]
            inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(grid[at:to], c), keys[np.repeat(first[at:to], c) + inside] - np.repeat(own[at:to], c)
            at = to


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of stretches (start, length, period) with equal start and length the one with the smallest period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    return runs[:, np.r_[True, (np.diff(runs[:2]) != 0).any(axis=0)]] if runs.shape[1] else runs


def find_runs(names: Names, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start, then period."""
    found = [np.empty((3, 0), np.int64)]
    # A pair inside a known run, a multiple of its period apart, can only lead to that run again:
    # q words in a row have the period p, a divisor of q, so a stretch of period q has it too.
    inside, known = np.zeros(names.n, np.int32), np.ones(1, np.int64)
    for i, j in _candidates(names, least):
        q, of = j - i, inside[i]
        fresh = (of == 0) | (of != inside[j]) | (q % known[of] != 0)
        i, j, q = i[fresh], j[fresh], q[fresh]
        start = i - names.backward(i, j)
        length = names.forward(i, j) + j - start
        good = length >= np.maximum(least, 2 * q)
        runs = _smallest(np.stack([start[good], length[good], q[good]]))
        found.append(runs)
        many = runs[:, runs[1] >= 8 * runs[2]]
        many = many[:, np.argsort(many[1], kind="stable")]  # of nested ones the longest counts
        for k, (a, n) in enumerate(zip(many[0].tolist(), many[1].tolist(), strict=True), len(known)):
            inside[a : a + n] = k
        known = np.concatenate([known, many[2]])
    runs = _smallest(np.concatenate(found, axis=1))
    start, length, period = runs[:, np.lexsort((runs[2], runs[0]))]
    return start, length, period


Edit = Callable[[int | None, int], np.ndarray | None]


def _portion(ids: list, texts: list, least: int, edit: Edit | None) -> pa.RecordBatch:
    of_doc = []
    for i, t in zip(ids, texts, strict=True):
        words = words_of(t)
        source = edit(i, len(words)) if edit else None
        of_doc.append(words if source is None else [words[k] for k in source.tolist()])
    sizes = np.array([len(w) for w in of_doc], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for ws in of_doc for w in ws), np.int64, int(sizes.sum()))
    start, length, period = find_runs(Names(words, np.repeat(np.arange(len(ids)), sizes)), least)
    doc = np.searchsorted(ends, start, "right")
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    drop = np.cumsum(change[:-1]) > 0
    cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
    collapsed = []
    for k, ws in enumerate(of_doc):
        if cuts[k + 1] > cuts[k]:
            ws = [w for w, gone in zip(ws, drop[starts[k] : ends[k]].tolist(), strict=True) if not gone]
        collapsed.append(b" ".join(ws))
    parts = [pa.array(x) for x in (start - starts[doc] if len(doc) else start, length, period)]
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period) and the text without repeated periods.

    ``collapsed`` holds the words joined by one space, without those that any run
    holds after its first period.  ``edit``, if given, gets doc_id and the number of
    words and returns for each word the place in the text that it is taken from, or
    None for the text as it is.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            for part in portions(texts):
                yield _portion(ids[at : at + len(part)], part, least, edit)
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    said = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    with_best = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat_ws("", F.transform(said, lambda s: F.concat(s, F.lit("\n")))).alias("said"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return with_best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000L * best.length div -best.period").alias("exponent_milli"),
        F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
