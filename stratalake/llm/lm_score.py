"""Operator 5: log10 probability of texts by causal self-attention on subword ids.

A text is lower-cased (A-Z) and cut into words; after the last word comes one
end.  Training documents are those that ``held_out`` doesn't name.

* Word counts over all training documents are gathered by the owners of word
  hashes (``exchange``), and each block of documents gets the counts of its own
  words, so the vocabulary, which grows with the input, is in no one place.
  They give the base score and the second part of ``mixed_score``.
* The attention model (``attention``) works on subword ids: those of a public
  byte-level vocabulary, and of pieces joined from them (``join_pieces``), that
  are most frequent in all training documents (``subword_counts``); other ids
  fall back to their parts, at last to bytes, so every text has ids.
* Its weights start from a bounded sample on the driver (``TRAIN_DOCS``, those
  with the smallest hash of doc_id, and ``TRAIN_IDS``) and then learn from every
  training document once, on the executors: in each of ``ROUNDS`` rounds every
  task trains a copy on its share of the round's documents, and the mean of the
  copies, weighted by their ids, begins the next round.
* ``score`` is the attention model's log10 probability of the text: the sum over
  its ids.  ``mixed_score`` takes for a word ``MIX`` times the product over its
  ids plus, for words of the training documents, 1 - ``MIX`` times their share
  of all training tokens.

Null and empty texts have the end alone; texts of any length are scored whole.
A row without doc_id is training text.  Repeated rows count as often as they
occur, get equal scores, and share a fold with all rows of their doc_id.  Other
columns of ``docs``, whatever their names, aren't read.  Without training text
the model is its start and no word is known; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import collections
import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm import exchange
from stratalake.llm.attention import CLASSES, MEMBERS, Adam, Attention, learn, train
from stratalake.llm.common import LONG_WORD, block_bytes, block_count, discard, lower_words, prepare, written

TRAIN_DOCS = 1500
TRAIN_IDS = 1_500_000
ROUNDS, RATE = 4, 2e-3
#: Pieces joined from public ids, by the counts of this many of the most frequent training words.
JOINED, JOIN_WORDS = 1500, 50_000
#: Weights in one row of what tasks send to be averaged.
_SLICE = 2048
MIX = 0.8
FOLDS = 10
_END = b"\x00end"
_OWN = CLASSES * MEMBERS
#: Smoothing of the base, fixed by its definition.
_ADD = 0.1


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def coded_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place of each word of the texts among them, how many words each text has); words as ``lower_words`` has them."""
    held = pa.array(texts, pa.large_binary())
    # Arrow's functions of ASCII work on bytes, whatever they are, but ask for strings.
    held = pa.Array.from_buffers(pa.large_string(), len(held), held.buffers(), held.null_count)
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(held, "")))
    words, ends = cut.flatten(), cut.offsets.to_numpy()
    del held, cut
    some = pc.binary_length(words).to_numpy() > 0  # space before the first or after the last word leaves an empty one
    n = np.diff(np.append(0, np.cumsum(some))[ends])
    words = words.filter(pa.array(some))
    coded = pa.Array.from_buffers(pa.large_binary(), len(words), words.buffers(), 0).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), n


def as_list(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Vocabulary(list):
    """The chosen ids, most frequent first; ids beyond the public ones are ``joined``: pieces in the order they were joined."""

    def __init__(self, ids=(), joined: tuple[bytes, ...] = ()):
        super().__init__(ids)
        self.joined = tuple(joined)


class Subwords:
    """Own ids of words: frequent ids of a public vocabulary and joined ones, their parts for the rest, 0 for the start and end."""

    REMEMBERED = 250_000
    _of: dict = {}

    def __init__(self, ranks: bytes, pattern: str, chosen: list[int] | None = None, joined: tuple[bytes, ...] = ()):
        import tiktoken

        self.joined = joined or getattr(chosen, "joined", ())
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        self.first = max(table.values()) + 1
        table |= {t: self.first + k for k, t in enumerate(self.joined)}
        # Where own ids are given a word is one piece: what is joined may hold a word and the mark after it.
        self.encoding = tiktoken.Encoding("subwords", pat_str=r" [^ ]+" if self.joined or chosen is not None else pattern, mergeable_ranks=table, special_tokens={})
        self.table = table
        self.token = {r: t for t, r in table.items()}
        self.starts = np.zeros(max(self.token) + 1, bool)
        self.starts[[r for r, t in self.token.items() if t[:1] == b" "]] = True
        self.byte = {t[0]: r for t, r in table.items() if len(t) == 1}
        self.known: dict[bytes, bytes] = {}
        self.chosen = chosen
        if chosen:
            self._expand()

    @classmethod
    def of(cls, ranks: bytes, pattern: str, chosen: list[int] | None, joined: tuple[bytes, ...] = ()) -> "Subwords":
        key = (zlib.crc32(ranks), pattern, zlib.crc32(repr((chosen, joined or getattr(chosen, "joined", ()))).encode()))
        if key not in cls._of:
            cls._of.clear()  # one at a time, for memory
            cls._of[key] = cls(ranks, pattern, chosen, joined)
        return cls._of[key]

    def public(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each word has), in one call: only the first id of a word has a space."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        start = np.flatnonzero(self.starts[ids])
        return ids, np.diff(np.append(start, len(ids)))

    def own(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(own ids of all words, how many each word has)."""
        ids, n = self.encoded(words)
        if not words:
            return ids.astype(np.uint16), n
        size = self.size[ids]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[ids] - (end - size), size) + np.arange(end[-1])]
        return flat, np.add.reduceat(size, np.cumsum(n) - n)

    def _expand(self) -> None:
        """What stands for each id: its own id, else those of the two parts with the lowest ids that make it."""
        own = {r: k for k, r in enumerate(self.chosen, 1)}
        self.expand = {}
        for t, r in sorted(self.table.items(), key=lambda x: (len(x[0]), x[1])):
            if r in own:
                self.expand[r] = (own[r],)
                continue
            parts = [(self.table[t[:k]], self.table[t[k:]]) for k in range(1, len(t)) if t[:k] in self.table and t[k:] in self.table]
            a, b = min(parts, key=lambda x: (len(self.expand[x[0]]) + len(self.expand[x[1]]), max(x), x))
            self.expand[r] = self.expand[a] + self.expand[b]
        self.size = np.zeros(len(self.starts), np.int64)
        for r, x in self.expand.items():
            self.size[r] = len(x)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.array([k for _, x in sorted(self.expand.items()) for k in x], np.uint16)

    def choose(self, found: dict[int, int]) -> "Subwords":
        """The own ids for counts of ids: all bytes and the most frequent ids, most frequent first."""
        counts = dict.fromkeys(self.byte.values(), 0) | found
        single = set(self.byte.values())
        best = sorted((r for r in counts if r not in single), key=lambda r: (-counts[r], r))[: _OWN - 1 - len(single)]
        self.chosen = Vocabulary(sorted([*single, *best], key=lambda r: (-counts[r], r)), self.joined)
        self._expand()
        return self

    def own_counts(self, found: dict[int, int]) -> np.ndarray:
        """How often each own id occurs, from counts of public ids."""
        out = np.zeros(_OWN)
        for r, n in found.items():
            for k in self.expand[r]:
                out[k] += n
        return out

    def remembered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``own``; the first words that come are remembered, among them the frequent ones."""
        new = [w for w in words if w not in self.known]
        flat, n = self.own(new)
        packed, end = flat.tobytes(), (2 * np.cumsum(n)).tolist()
        found = {w: packed[a:b] for w, a, b in zip(new, [0, *end], end)}
        ids = [self.known.get(w) or found[w] for w in words]
        self.known.update((w, x) for w, x in itertools.islice(found.items(), self.REMEMBERED - len(self.known)) if len(w) <= LONG_WORD)
        return np.frombuffer(b"".join(ids), np.uint16), np.fromiter(map(len, ids), np.int64, len(ids)) // 2

    def stream(self, words: list[bytes]) -> np.ndarray:
        """0 (start), own ids of the words, 0 (end)."""
        return np.concatenate([[0], self.remembered(words)[0], [0]]).astype(np.uint16)

    def streams(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The streams of texts one after another, where each starts, and how many ids follow its first."""
        words, places, n = coded_words(texts)
        flat, length = self.remembered(as_list(words))
        size = length[places]
        end = np.append(0, np.cumsum(size))
        last = np.cumsum(n)
        tokens = end[last] - end[last - n]
        ids = np.zeros(int(end[-1]) + 2 * len(n), np.uint16)
        kind = np.int32 if len(ids) < 2**31 else np.int64  # for memory
        to, of = (np.arange(int(end[-1]), dtype=kind) for _ in range(2))
        to += np.repeat((2 * np.arange(len(n)) + 1).astype(kind), tokens)
        of += np.repeat(((np.cumsum(length) - length)[places] - end[:-1]).astype(kind), size)
        ids[to] = flat[of]
        return ids, np.cumsum(tokens + 2) - (tokens + 2), tokens + 1

    def ids(self, word: bytes) -> bytes:
        """Own ids of a word as u2."""
        return self.own([word])[0].tobytes()


def _training() -> Column:
    return ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_words(docs: DataFrame) -> DataFrame:
    """How often each word occurs in all training documents, as a written table (word, n)."""
    size = block_bytes(docs.sparkSession)

    def run(batches):
        for block in exchange.blocks(batches, size):
            words, places, _ = coded_words(block.texts)
            n = np.bincount(places, minlength=len(words))
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([words[k : k + 20_000].cast(pa.binary()), pa.array(n[k : k + 20_000], pa.int64())], ["word", "n"])

    return written(exchange.scan(docs.filter(_training())).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def subword_counts(words: DataFrame, ranks: bytes, pattern: str, joined: tuple[bytes, ...] = ()) -> dict[int, int]:
    """How often each id occurs in all training words; bounded by the vocabulary."""
    held = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        subwords = Subwords.of(held.value, pattern, [], joined)
        counts = np.zeros(len(subwords.starts), np.int64)
        for b in batches:
            ids, size = subwords.encoded(b.column(0).to_pylist())
            np.add.at(counts, ids, np.repeat(b.column(1).to_numpy(), size))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], ["id", "n"])

    rows = words.select("word", "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def join_pieces(words: list[tuple[bytes, int]], subwords: Subwords, most: int) -> tuple[bytes, ...]:
    """Byte-pair encoding goes on from the public ids of these words: the most frequent neighbours become a piece, again and again."""
    texts = [[subwords.token[r] for r in subwords.public(w)] for w, _ in words]
    weight = [n for _, n in words]
    counts, where = collections.Counter(), collections.defaultdict(set)
    for k, t in enumerate(texts):
        for pair in itertools.pairwise(t):
            counts[pair] += weight[k]
            where[pair].add(k)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    joined: dict[bytes, None] = {}
    while heap and len(joined) < most:
        n, pair = heapq.heappop(heap)
        if -n != counts[pair]:  # an older entry
            if counts[pair] > 0:
                heapq.heappush(heap, (-counts[pair], pair))
            continue
        if -n < 2:
            break
        piece = pair[0] + pair[1]
        if piece not in subwords.table:
            joined[piece] = None
        changed = set()
        for k in where.pop(pair):
            t, out, at = texts[k], [], 0
            while at < len(t):
                two = at + 1 < len(t) and t[at] == pair[0] and t[at + 1] == pair[1]
                out.append(piece if two else t[at])
                at += 2 if two else 1
            if len(out) == len(t):
                continue
            for old in itertools.pairwise(t):
                counts[old] -= weight[k]
            for new in itertools.pairwise(out):
                counts[new] += weight[k]
                where[new].add(k)
                changed.add(new)
            texts[k] = out
        counts.pop(pair, None)
        for new in changed:
            heapq.heappush(heap, (-counts[new], new))
    return tuple(joined)


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.reshape(-1) for x in weights.values()])


def learned(docs: DataFrame, ranks: bytes, pattern: str, chosen: list[int], weights: dict[str, np.ndarray], number: int, rounds: int) -> dict[str, np.ndarray]:
    """The weights after one round: the mean of the copies that tasks train on their training documents of the round."""
    held = docs.sparkSession.sparkContext.broadcast((ranks, chosen, weights))
    rate, size = RATE * (1 - number / rounds), block_bytes(docs.sparkSession)

    def run(batches):
        ranks, chosen, weights = held.value
        subwords, model, n, part = Subwords.of(ranks, pattern, chosen), Attention({k: x.copy() for k, x in weights.items()}), 0, 0
        adam = Adam(model)
        for block in exchange.blocks(batches, size):
            ids, starts, lengths = subwords.streams(block.texts)
            learn(model, adam, ids, starts, lengths, rate, seed=block.number)
            n, part = n + int(lengths.sum()), block.part
        if n:
            w = _flat(model.p)
            rows = [w[k : k + _SLICE].tobytes() for k in range(0, len(w), _SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([n] * len(rows), pa.int64()), pa.array(rows, pa.binary())],
                ["slice", "part", "n", "w"],
            )

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "w")), strict=True))
        total, out = sum(n for _, n, _ in rows), 0.0
        for _, n, w in rows:
            out = out + np.frombuffer(w, np.float32).astype(np.float64) * (n / total)
        return pa.table({"slice": table.column("slice")[:1], "w": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    mine = _training() & (F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)), F.lit(0)) == number)
    sent = exchange.scan(docs.filter(mine)).mapInArrow(run, "slice int, part int, n long, w binary")
    rows = sorted(sent.groupBy("slice").applyInArrow(mean, "slice int, w binary").collect())
    held.destroy()
    if not rows:
        return weights
    w, at, out = np.frombuffer(b"".join(bytes(r["w"]) for r in rows), np.float32), 0, {}
    for k, x in weights.items():
        out[k] = w[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def fit(docs: DataFrame, ranks: bytes, pattern: str, most_docs: int = TRAIN_DOCS, most_ids: int = TRAIN_IDS, rounds: int = ROUNDS) -> tuple[list[int], dict[str, np.ndarray]]:
    """(chosen ids, weights): a start from a bounded sample, then one pass over all training documents."""
    words = training_words(docs)
    often = words.orderBy(F.desc("n"), "word").limit(JOIN_WORDS).collect()
    joined = join_pieces([(bytes(r["word"]), r["n"]) for r in often], Subwords(ranks, pattern), JOINED)
    found = subword_counts(words, ranks, pattern, joined)
    discard(words)
    subwords = Subwords(ranks, pattern, [], joined).choose(found)
    chosen = docs.filter(_training() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("text").cast("binary")).collect()
    streams, total = [], 0
    for r in sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1] or b"")):
        if total >= most_ids:
            break
        streams.append(subwords.stream(lower_words(bytes(r[1] or b"")))[: most_ids - total + 2])
        total += len(streams[-1]) - 2
    if not streams:
        streams = [np.zeros(2, np.uint16)]
    sizes = np.array([len(s) for s in streams], np.int64)
    counts = subwords.own_counts(found)
    counts[0] = 2 * len(streams)
    weights = train(np.concatenate(streams), np.cumsum(sizes) - sizes, sizes - 1, counts=counts).p
    for number in range(rounds):
        weights = learned(docs, ranks, pattern, subwords.chosen, weights, number, rounds)
    return subwords.chosen, weights


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def word_counts(docs: DataFrame, owners: int) -> tuple[exchange.Answers, int, int]:
    """(counts in all training documents of the words of each block, all training tokens, distinct ones)."""

    def make(block):
        words, places, size = coded_words(block.texts)
        of = np.array([not is_held_out(i) for i in block.ids])
        h = np.fromiter(map(_hash, [_END, *as_list(words)]), np.uint64, len(words) + 1)
        n = np.append(of.sum(), np.bincount(places, np.repeat(of, size), len(words)).astype(np.int64))
        order = np.argsort(h)
        yield from exchange.messages(block, owners, h[order], n[order])

    def own(got):
        h = np.concatenate([x[3][0] for x in got])
        keys, where = np.unique(h, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate([x[3][1] for x in got]))
        yield -1, 0, int(total.sum()), b""
        yield -2, 0, int((total > 0).sum()), b""
        at = 0
        for part, number, mark, (k, _) in got:
            yield part, number, mark, exchange.pack(k, total[where[at : at + len(k)]])
            at += len(k)

    answers = exchange.Answers(exchange.answer(exchange.send(docs, owners, make), own), "counts", owners)
    sums = docs.sparkSession.read.schema(exchange.ANSWER).parquet(answers.path).filter("part < 0").groupBy("part").agg(F.sum("mark").alias("n")).collect()
    found = {r["part"]: r["n"] for r in sums}
    return answers, found.get(-1, 0), found.get(-2, 0)


def score(docs: DataFrame, ranks_path: str, pattern: str, mix: float = MIX) -> DataFrame:
    """One row per row of ``docs`` (a plain table of files): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score."""
    spark = prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    answers, total, distinct = word_counts(docs, block_count(docs))
    read = answers.reader()
    held = spark.sparkContext.broadcast((ranks, *fit(docs, ranks, pattern)))
    divisor, size = total + _ADD * (distinct + 1), block_bytes(spark)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        ranks, chosen, weights = held.value
        subwords, model = Subwords.of(ranks, pattern, chosen), Attention(weights)
        for block in exchange.blocks(batches, size):
            distinct, places, sizes = coded_words(block.texts)
            distinct = as_list(distinct)
            h = np.fromiter(map(_hash, [_END, *distinct]), np.uint64, len(distinct) + 1)
            got = read(block)
            keys, counts = (np.concatenate([x[k] for x in got]) for k in (0, 1))
            order = np.argsort(keys)
            c = counts[order][np.searchsorted(keys[order], h)]
            base = np.log10((c + _ADD) / divisor)
            known = c > 0
            share = np.where(known, (c + _ADD) / divisor, 0.0)
            flat, length = subwords.remembered(distinct)
            flat, length = np.append(np.uint16(0), flat), np.append(1, length)
            begin = np.cumsum(length) - length
            # Documents of the block in groups, for the memory of ids and scores.
            at = done = 0
            while at < len(sizes):
                end, n = at, 0
                while end < len(sizes) and (end == at or n + sizes[end] < 50_000):
                    n += int(sizes[end]) + 1
                    end += 1
                lengths = sizes[at:end].astype(np.int64) + 1
                words = np.zeros(int(lengths.sum()), np.int64)  # 0: the end
                ends = np.cumsum(lengths)
                own = np.ones(len(words), bool)
                own[ends - 1] = False
                words[own] = places[done : done + len(words) - len(lengths)].astype(np.int64) + 1
                done += len(words) - len(lengths)
                w_size = length[words]
                w_start = np.cumsum(w_size) - w_size
                doc = np.repeat(np.arange(len(lengths)), lengths)
                # Each document: 0 (start), ids of its words, 0 (end).
                place = w_start + doc + 1
                ids = np.zeros(int(w_size.sum()) + len(lengths), np.uint16)
                spread = np.repeat(place - w_start, w_size) + np.arange(int(w_size.sum()))
                ids[spread] = flat[np.repeat(begin[words] - w_start, w_size) + np.arange(int(w_size.sum()))]
                first = place[ends - lengths] - 1
                tokens = np.add.reduceat(w_size, ends - lengths)
                logs = model.score(ids, first, tokens)
                each = np.add.reduceat(logs[spread], w_start) if len(words) else np.empty(0)
                p = mix * np.exp(each) + (1 - mix) * share[words]
                value = np.where(p > 0, np.log10(np.maximum(p, 1e-300)), each / np.log(10) + np.log10(mix))
                cut = ends - lengths
                columns = [
                    block.ids[at:end], [is_held_out(i) for i in block.ids[at:end]], lengths, np.add.reduceat(known[words].astype(np.int64), cut),
                    np.full(len(lengths), total), np.add.reduceat(base[words], cut), np.add.reduceat(each, cut) / np.log(10), np.add.reduceat(value, cut),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)
                at = end

    return exchange.scan(docs).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double")
