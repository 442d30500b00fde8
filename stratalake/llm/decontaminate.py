"""Operator 2: benchmark decontamination by greedy string tiling.

Words are case-folded for all letters of Unicode, in composed form, without
ASCII punctuation.  A tile is a run of ``MIN_TILE`` or
more equal words of a benchmark item and a document; tiles never overlap, and
longer ones are marked first, so passages that were put in another order still
cover the item.  A document is contaminated by an item of whose words tiles
cover ``COVERAGE`` or more.

1. Seeds: every ``MIN_TILE`` consecutive words of the items, hashed, make a
   sorted index.  Documents are probed with all their windows, a batch at a
   time; almost all documents share no seed and end here.
2. For each item that shares a seed, the parts of the document that its seeds
   cover are tiled by running Karp-Rabin: hash all unmarked windows of length
   s, extend equal ones, mark the longest first, then shorten s.

The index of a benchmark of up to ``BROADCAST_BYTES`` of text is broadcast, and
no document moves.  A larger benchmark is joined: a bit field of fixed size
tells documents apart that can share no seed, the others' seeds meet those of
the items by hash, and each pair of a text and an item that share one is tiled
where the two meet.  Nothing that is collected or broadcast grows with the data.

Null and empty texts match nothing; items of fewer than ``MIN_TILE`` words hold
no tile and match nothing; rows that repeat an item_id are one item each, and
repeated documents get the same matches.  Of equally long tiles the one that is
first in the item, then in the text, is marked first.  Texts of any length are
searched whole; other columns of the documents, whatever their names, stay as
they are.  Without documents or items there are no matches.
"""

from __future__ import annotations

import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.llm.common import HASHES, ngrams, normalised_words, own_column, portions, prepare, written

MIN_TILE = 5
COVERAGE = 0.5
BROADCAST_BYTES = 8 << 20
#: Bits of the field that tells which seeds may be of an item (4 MB).
FIELD = 1 << 25
MATCHES = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.LongType())])
)


def folded_words(text: str | bytes | None) -> list[bytes]:
    """Words of ``normalised_words`` of the text in composed form, case-folded (``É`` as ``é``, ``ẞ`` as ``ss``)."""
    if text is None or text.isascii():
        return normalised_words(text)
    if isinstance(text, bytes):
        text = text.decode("utf-8", "surrogateescape")
    # Folding may take a letter apart, so it is composed again.
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return normalised_words(text.encode("utf-8", "surrogateescape"))


def tiles(pattern: list[int], text: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length), longest first.

    Of equally long matches the one earliest in the pattern, then in the text, is first.
    """
    used_p, used_t = bytearray(len(pattern)), bytearray(len(text))
    out: list[tuple[int, int, int]] = []
    s = max(least, min(len(pattern), 4 * least))
    while True:
        found = _matches(pattern, text, used_p, used_t, s)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * s:  # far longer ones exist: look for those first
            s = longest
            continue
        heap = [(-n, p, t) for n, p, t in found]
        heapq.heapify(heap)
        while heap:
            n, p, t = heapq.heappop(heap)
            n = -n
            free = [k for k in range(n) if not used_p[p + k] and not used_t[t + k]]
            if len(free) == n:
                used_p[p : p + n] = used_t[t : t + n] = b"\x01" * n
                out.append((p, t, n))
                continue
            at = 0
            while at < len(free):  # what is left of an overlapped match, if still long enough
                end = at
                while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                    end += 1
                if end - at + 1 >= s:
                    heapq.heappush(heap, (-(end - at + 1), p + free[at], t + free[at]))
                at = end + 1
        if s == least:
            return out
        s = max(least, s // 2)


def _matches(pattern: list[int], text: list[int], used_p: bytearray, used_t: bytearray, s: int) -> list[tuple[int, int, int]]:
    """(length, place, place) of maximal unmarked equal runs of ``s`` words or more, by Karp-Rabin hashes."""
    places: dict[int, list[int]] = {}
    for at, h in _rolling(text, used_t, s):
        places.setdefault(h, []).append(at)
    out = []
    for p, h in _rolling(pattern, used_p, s):
        for t in places.get(h, ()):
            if p and t and pattern[p - 1] == text[t - 1] and not used_p[p - 1] and not used_t[t - 1]:
                continue  # found from an earlier start
            n = 0
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                n += 1
            if n >= s:
                out.append((n, p, t))
    return out


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _rolling(words: list[int], used: bytearray, s: int):
    """(start, hash) of each window of ``s`` unmarked words."""
    power, h, run = pow(_BASE, s, _PRIME), 0, 0
    for k, w in enumerate(words):
        if used[k] or w < 0:
            h = run = 0
            continue
        h = h * _BASE + w + 1
        run += 1
        if run > s:
            h -= (words[k - s] + 1) * power
        h %= _PRIME
        if run >= s:
            yield k - s + 1, h


class Index:
    """Seeds of a benchmark that one task can hold."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = MIN_TILE):
        self.least, self.vocabulary = least, {}
        self.ids, self.words, seeds = [], [], []
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text)]
            if len(words) < least:
                continue
            seeds.append(ngrams(np.array(words, np.uint64), least))
            self.ids.append(item_id)
            self.words.append(words)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        h = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        self.seeds, numbers = np.unique(h, return_inverse=True)
        # Each place of each seed, by seed; and the distinct seeds of each item.
        owners, places = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds]), np.concatenate([np.arange(len(x)) for x in seeds]) if seeds else np.empty(0, np.int64)
        order = np.argsort(numbers, kind="stable")
        self.owners, self.places = owners[order], places[order]
        self.first = np.searchsorted(numbers[order], np.arange(len(self.seeds) + 1))
        ends = np.cumsum([len(x) for x in seeds])
        self.of_item = [np.unique(numbers[end - len(x) : end]) for x, end in zip(seeds, ends, strict=True)]

    def coverable(self, seeds: np.ndarray, threshold: float) -> np.ndarray:
        """Items of whose words these seeds cover the threshold's share or more; no tile holds a word that no shared seed covers."""
        counts = self.first[seeds + 1] - self.first[seeds]
        at = np.arange(int(counts.sum())) + np.repeat(self.first[seeds] - np.cumsum(counts) + counts, counts)
        owners, places = self.owners[at], self.places[at]
        order = np.lexsort((places, owners))
        owners, places = owners[order], places[order]
        step = np.full(len(owners), self.least)  # words that a seed covers before the item's next seed does
        same = owners[1:] == owners[:-1]
        step[:-1][same] = np.minimum(self.least, places[1:][same] - places[:-1][same])
        covered = np.bincount(owners, step, len(self.lengths))
        return np.flatnonzero((covered > 0) & (covered / self.lengths >= threshold))

    def batch(self, texts: list[bytes | None], threshold: float) -> list[list[dict]]:
        """For each text the items that contaminate it."""
        return [x for some in portions(texts) for x in self._batch(some, threshold)]

    def _batch(self, texts: list[bytes | None], threshold: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.seeds):
            return out
        get = self.vocabulary.get
        known = [np.fromiter((get(w, 0) for w in folded_words(t)), np.uint64) for t in texts]
        ends = np.cumsum([len(x) + 1 for x in known])
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        for x, end in zip(known, ends, strict=True):
            ids[end - 1 - len(x) : end - 1] = x  # a 0 follows each text
        m = len(ids) - self.least + 1
        if m <= 0:
            return out
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        starts = np.flatnonzero(unknown[self.least :] == unknown[: -self.least])
        if not len(starts):
            return out
        grams = ids[starts]  # hashes of windows of known words alone
        windows = np.stack([ids[starts + k] for k in range(self.least)], axis=1)
        grams = ngrams(windows.reshape(-1), self.least)[:: self.least]
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = self.seeds[at] == grams
        starts, at = starts[hit], at[hit]
        docs = np.searchsorted(ends, starts, "right")
        cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]) if len(docs) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d, mine, seeds = int(docs[a]), starts[a:b], at[a:b]
            for o in self.coverable(np.unique(seeds), threshold).tolist():
                places = mine[np.isin(seeds, self.of_item[o])].tolist()
                got = tiles(self.words[o], islands(ids, places, self.least), self.least)
                coverage = sum(n for _, _, n in got) / len(self.words[o])
                if coverage >= threshold:
                    out[d].append({"item_id": self.ids[o], "coverage": coverage, "tiles": len(got)})
        return out


def islands(ids: np.ndarray, places: list[int], least: int) -> list[int]:
    """The words that seeds cover, with a -1 between parts; every tile lies in one part."""
    out: list[int] = []
    end = -1
    for p in places:
        if p > end and out:
            out.append(-1)
        out += ids[max(p, end) : p + least].tolist()
        end = max(end, p + least)
    return out


def _field(seeds: np.ndarray) -> np.ndarray:
    """The bit field with these seeds."""
    bits = np.zeros(FIELD // 8, np.uint8)
    at = seeds % np.uint64(FIELD)
    np.bitwise_or.at(bits, (at // np.uint64(8)).astype(np.int64), (1 << (at % np.uint64(8))).astype(np.uint8))
    return bits


def _in_field(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at = seeds % np.uint64(FIELD)
    return (bits[(at // np.uint64(8)).astype(np.int64)] >> (at % np.uint64(8)).astype(np.uint8)) & 1 > 0


_WORDS = pa.list_(pa.int64())


def _joined(docs: DataFrame, benchmark: DataFrame, threshold: float, text: str, least: int = MIN_TILE) -> DataFrame:
    """(digest, matches) of the texts of ``docs`` that items of a benchmark of any size contaminate; digest: SHA-256 of the text."""
    spark = docs.sparkSession

    def hashes(t: bytes | None) -> np.ndarray:
        return HASHES.array(folded_words(t)) >> np.uint64(1)  # fits a signed number

    def of_items(batches):
        for b in batches:
            words = [hashes(t) for t in b.column(2).to_pylist()]
            every = [ngrams(w, least) for w in words]
            lists = [[w.view(np.int64) for w in words], [np.unique(s).view(np.int64) for s in every], [s.view(np.int64) for s in every]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, _WORDS) for x in lists)], ["item", "item_id", "words", "seeds", "all_seeds"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    items = written(rows.mapInArrow(of_items, "item long, item_id long, words array<long>, seeds array<long>, all_seeds array<long>"), "items")

    def fields(batches):
        bits = np.zeros(FIELD // 8, np.uint8)
        for b in batches:
            for s in b.column(0).to_pylist():
                bits |= _field(np.array(s or [], np.int64).view(np.uint64))
        step = 1 << 16
        yield pa.RecordBatch.from_arrays([pa.array(range(0, len(bits), step), pa.int64()), pa.array([bits[k : k + step].tobytes() for k in range(0, len(bits), step)], pa.binary())], ["at", "bits"])

    # Some tasks' fields, each of fixed size, are united a slice at a time.
    parts = items.select("seeds").coalesce(16).mapInArrow(fields, "at long, bits binary")

    def united(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"at": table.column("at")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    slices = sorted(parts.groupBy("at").applyInArrow(united, "at long, bits binary").collect())
    held = spark.sparkContext.broadcast(np.frombuffer(b"".join(bytes(r["bits"]) for r in slices) or bytes(FIELD // 8), np.uint8))

    def of_docs(batches):
        bits = held.value
        for b in batches:
            out = []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = hashes(t)
                grams = ngrams(words, least)
                places = np.flatnonzero(_in_field(bits, grams)) if len(grams) else grams
                if len(places):
                    out.append((digest, islands(words, places.tolist(), least), np.unique(grams[places]).view(np.int64)))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), _WORDS, _WORDS), strict=True)], ["digest", "words", "seeds"])

    texts = docs.select(F.sha2(F.col(text), 256).alias("digest"), F.col(text).cast("binary").alias("t")).filter("digest is not null")
    found = written(texts.mapInArrow(of_docs, "digest string, words array<long>, seeds array<long>"), "probes")
    # Each text once; the pairs that share a seed, before any words move.  An item is looked for by its rarer seeds alone.
    seeds = found.select("digest", F.explode("seeds").alias("seed")).distinct()
    pairs = written(seeds.join(_needed(items, threshold, least), "seed").select("digest", "item").distinct(), "pairs")

    def tile(batches):
        for b in batches:
            out = []
            for digest, item_id, words, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = tiles(own, words, least)
                coverage = sum(n for _, _, n in got) / len(own)
                if coverage >= threshold:
                    out.append((digest, item_id, coverage, len(got)))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "item_id", "coverage", "tiles"])

    both = pairs.join(found.select("digest", "words").dropDuplicates(["digest"]), "digest").join(items.select("item", "item_id", F.col("words").alias("own")), "item")
    matches = both.select("digest", "item_id", "words", "own").mapInArrow(tile, "digest string, item_id long, coverage double, tiles long")
    return matches.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias("matches"))


def _needed(items: DataFrame, threshold: float, least: int) -> DataFrame:
    """(item, seed) of the seeds by which each item is found.

    The seeds that most items have are left out, as long as the words that they cover
    stay below the threshold's share: a text that reaches it holds another seed too.  So
    a line that many items and many texts share brings no pairs.
    """
    often = items.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    counted = items.select("item", F.size("words").alias("n_words"), F.posexplode("all_seeds").alias("place", "seed")).join(often, "seed")
    by_item = counted.groupBy("item", "n_words").agg(F.collect_list(F.struct("seed", "n", "place")).alias("places"))

    def keep(batches):
        for b in batches:
            out = [], []
            for item, n_words, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of_seed: dict[int, list[int]] = {}
                often = {}
                for p in places:
                    of_seed.setdefault(p["seed"], []).append(p["place"])
                    often[p["seed"]] = p["n"]
                covered: set[int] = set()
                order = sorted(of_seed, key=lambda s: (-often[s], s))
                for k, seed in enumerate(order):
                    covered.update(x for at in of_seed[seed] for x in range(at, at + least))
                    if len(covered) / n_words >= threshold:
                        out[0].extend([item] * (len(order) - k))
                        out[1].extend(order[k:])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "seed"])

    return by_item.mapInArrow(keep, "item long, seed long")


def annotate(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, name: str = "matches", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a column of the items that contaminate each row."""
    spark = prepare(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        digest = own_column(docs, "digest_of_text")
        found = _joined(docs, benchmark, threshold, text).select(F.col("digest").alias(digest), F.col("matches").alias(own_column(docs, "found_matches")))
        marked = docs.withColumn(digest, F.sha2(F.col(text), 256)).join(found, digest, "left")
        return marked.select(*docs.columns, F.coalesce(found.columns[1], F.array().cast(MATCHES)).cast(MATCHES).alias(name))
    rows = benchmark.select("item_id", "text").collect()
    held = spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1] or ""))))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())]))
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            got = held.value.batch(b.column(at).cast(pa.binary()).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, MATCHES)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each document and item that contaminates it."""
    found = annotate(docs.select("doc_id", "text"), benchmark, threshold)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.coverage", "m.tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    name = own_column(docs, "matches")
    return annotate(docs, benchmark, threshold, name).filter(F.size(name) == 0).drop(name)
