"""Operator 8: removal of repeated passages by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if
a window that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document.

1. Every document is cut into blocks of ``ANCHOR`` words that don't overlap;
   these are the index.  A repeated window of ``WINDOW`` >= 2 * ``ANCHOR`` - 1
   words holds one of the other place's blocks whole, so probing the index with
   every rolling window of ``ANCHOR`` words misses nothing.  Index and probes
   meet at the owners of hashes as short hash prefixes, a few bits a word.
2. Hits are extended to whole repeats: every window that holds a hit is looked
   up by its full hashes, and owners name the block of documents where it starts
   first.  Runs of windows that start earlier elsewhere are the maximal repeats;
   texts never meet, so they are compared by hashes and not word by word.
3. Words covered by such windows are removed.

A window's identity is two 64-bit hashes of its words' 64-bit hashes.  Null and
empty texts have no words; texts of any length are taken whole.  Rows with equal
doc_id, repeated rows too, are ordered by their place in the table; null ids
come last.  Columns other than doc_id and text aren't read, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalake.llm import exchange
from stratalake.llm.common import HASHES, block_bytes, block_count, ngrams, prepare, scramble, words_of

WINDOW = 20
ANCHOR = 10
_LAST = np.int64(2**63 - 1)


class Words:
    """Hashes of the words of a block's documents in order of doc_id, one after another."""

    def __init__(self, block: exchange.Block):
        self.order = sorted(range(len(block.ids)), key=lambda k: (block.ids[k] is None, block.ids[k] or 0, k))
        self.ids = np.array([_LAST if block.ids[k] is None else block.ids[k] for k in self.order], np.int64)
        hashes = [HASHES.array(words_of(block.texts[k])) for k in self.order]  # words themselves take ten times the room
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.total = int(self.ends[-1]) if len(self.ends) else 0
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(hashes), dtype=np.int32), self.lengths)

    def windows(self, n: int) -> np.ndarray:
        """The places where a window of ``n`` words of one document starts."""
        if self.total < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[: self.total - n + 1] == self.doc[n - 1 :])


def _anchors(w: Words, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    at = w.windows(anchor)
    return at, ngrams(w.hashes, anchor)[at] if len(at) else np.empty(0, np.uint64)


def _long(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows and two 64-bit hashes of each, from those of their two halves (which overlap if ``window`` is odd)."""
    at = w.windows(window)
    if not len(at):
        return at, np.empty(0, np.uint64), np.empty(0, np.uint64)
    half, out = -(-window // 2), []
    for words in (w.hashes, scramble(w.hashes + np.uint64(0xD1B54A32D192ED03))):
        h = ngrams(words, half)
        out.append(scramble(scramble(h[at]) + np.uint64(0x9E3779B97F4A7C15) * h[at + window - half]))
    return at, *out


def _firsts(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first of each run of equal windows in arrays that are sorted by both hashes."""
    return np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.empty(0, bool)


def find_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, owners: int | None = None):
    """Answers of step 2 for each block of ``docs``: hashes of windows that start earlier in another block."""
    if window < 2 * anchor - 1:
        raise ValueError("a window must hold a whole anchor at any place")
    owners = owners or block_count(docs)
    # Prefixes long enough that of 2**8 windows that occur once about one is taken for a hit.
    bits = min(64, (max(1, owners * block_bytes(docs.sparkSession) // 4)).bit_length() + 8)
    cut = np.uint64(64 - bits)

    def probes(block):
        w = Words(block)
        at, h = _anchors(w, anchor)
        h = h >> cut
        aligned = (at - w.starts[w.doc[at]]) % anchor == 0
        keys, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        indexed = np.bincount(where[aligned], minlength=len(keys)) > 0
        yield from exchange.messages(block, owners, keys, indexed.astype(np.uint8) + 2 * (counts > 1).astype(np.uint8), bits=bits)

    def hits(got):
        keys = np.concatenate([x[3][0] for x in got])
        flags = np.concatenate([x[3][1] for x in got])
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])
        both = np.bitwise_or.reduceat(flags[order], starts)
        several = (np.diff(np.r_[starts, len(keys)]) > 1) | (both & 2 > 0)
        hit = np.empty(len(keys), bool)
        hit[order] = np.repeat(several & (both & 1 > 0), np.diff(np.r_[starts, len(keys)]))
        at = 0
        for part, number, mark, (k, _) in got:
            mine = hit[at : at + len(k)]
            at += len(k)
            if mine.any():
                yield part, number, mark, exchange.pack(k[mine])

    anchored = exchange.Answers(exchange.answer(exchange.send(docs, owners, probes), hits), "anchors", owners)
    read = anchored.reader()

    def candidates(block):
        found = [x[0] for x in read(block)]
        if not found:
            return
        keys = np.sort(np.concatenate(found))
        w = Words(block)
        at, h = _anchors(w, anchor)
        h = h >> cut
        near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.zeros(w.total + 1, np.int64)
        hit[at[keys[near] == h] + 1] = 1
        before = np.cumsum(hit)  # hits that start before a place
        at, h, g = _long(w, window)
        holds = before[at + window - anchor + 1] > before[at]
        at, h, g = at[holds], h[holds], g[holds]
        order = np.lexsort((g, h))  # stable, and places are in order, so the first of equals is each window's first
        order = order[_firsts(h[order], g[order])]
        at = at[order]
        doc = w.doc[at]
        yield from exchange.messages(block, owners, h[order], g[order], w.ids[doc], (at - w.starts[doc]).astype(np.int64))

    def later(got):
        h, g, ids, place = (np.concatenate([x[3][k] for x in got]) for k in range(4))
        size = [len(x[3][0]) for x in got]
        source = np.repeat(np.arange(len(got)), size)
        part = np.array([x[0] for x in got])[source]
        number = np.array([x[1] for x in got])[source]
        # A doc_id that rows share goes by the rows' place in the table.
        order = np.lexsort((place, number, part, ids, g, h))
        lost = np.zeros(len(h), bool)
        lost[order[~_firsts(h[order], g[order])]] = True
        at = 0
        for (p, n, mark, (k, other, _, _)), s in zip(got, size, strict=True):
            mine = lost[at : at + s]
            at += s
            if mine.any():
                yield p, n, mark, exchange.pack(k[mine], other[mine])

    return exchange.Answers(exchange.answer(exchange.send(docs, owners, candidates), later), "repeats", owners), anchored


def covered(w: Words, lost: list[np.ndarray], window: int) -> np.ndarray:
    """Which words of a block are removed; ``lost``: both hashes of windows that start earlier in another block."""
    at, h, g = _long(w, window)
    # The lost windows come before the block's own, so of equals only a block's first window that isn't lost stays.
    every, other = np.concatenate([lost[0], h]), np.concatenate([lost[1], g])
    order = np.lexsort((other, every))
    repeat = np.ones(len(every), bool)
    repeat[order[_firsts(every[order], other[order])]] = False
    repeat = repeat[len(lost[0]) :]
    change = np.zeros(w.total + 1, np.int64)
    np.add.at(change, at[repeat], 1)
    np.add.at(change, at[repeat] + window, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256[, kept: the kept words joined by spaces].

    ``docs`` must be a plain table of files.
    """
    prepare(docs.sparkSession)
    answers, anchored = find_repeats(docs, window, anchor)
    anchored.discard()
    read = answers.reader()
    names, size = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts, block_bytes(docs.sparkSession)

    def run(batches):
        for block in exchange.blocks(batches, size):
            w = Words(block)
            found = read(block)
            gone = covered(w, [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.uint64)] * 2, window)
            rows = []
            for k, a, b in zip(w.order, w.starts.tolist(), w.ends.tolist(), strict=True):
                words, out = words_of(block.texts[k]), gone[a:b]
                n = int(out.sum())
                kept = b" ".join([x for x, g in zip(words, out.tolist(), strict=True) if not g] if n else words)
                rows.append((block.ids[k], len(words), n, hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if texts else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return exchange.scan(docs).mapInArrow(run, schema)
