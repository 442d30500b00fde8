"""Operator 13: toxicity by two class-conditional Kneser-Ney models.

Words are lower-cased runs of letters and digits; a text ends with an end sign,
which is scored as a word, so empty and null texts have one.  Counts are numbers of
documents that hold a pair of words or a word, so that what one text repeats counts
once.  For each class c, toxic and ordinary, with discounts D from the counts of
counts and T the number of different followers or words:

* ``P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + D T_c(v) / n_c(v) * P_c(w)``, for
  pairs in ``LEAST_PAIR`` documents or more; other pairs fall back as if never seen;
* ``P_c(w) = max(n_c(w) - D, 0) / n_c + D T_c / n_c * P(w)``;
* ``P(w)`` from the continuation counts that both classes share: in how many classes
  w occurs, discounted, the rest evenly over all words and one unknown word.

So what is rare in both classes has nearly the same probability in both.  A text's
evidence are the mean toxic less the mean ordinary log-likelihood of its words, which
length doesn't change, and the largest difference of one word.  Logistic weights of
both make the score; they are fitted on the sampled rows, each scored as if it hadn't
been counted (its class's counts less one).

Training reads a bounded sample of labelled rows outside the held-out quarter:
of each class the ``TRAIN_EACH`` rows with the smallest hash of doc_id, whole
texts of at most ``LONGEST`` words, as long as they have ``TRAIN_WORDS`` words
together; counts reach the driver and the tasks, so they are bounded by that.  All
rows are scored, whole, in a scan without shuffle.

Rows are scored one by one: equal texts score alike, and repeated rows and ids
stay as often as they occur.  A doc_id with several labels has the largest; of
rows that share a labelled doc_id the one with the smallest text is learned from.
Rows without doc_id are never learned from.  Columns other than doc_id and text
aren't read, whatever their names.  Without rows of both classes every score is the
share of toxic labels (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import HASHES, LONG_WORD, discard, normalised_words, own_column, portions, prepare, written

#: The most rows of a class, and words of a text and of a class, that training reads.
TRAIN_EACH, LONGEST, TRAIN_WORDS = 4000, 50_000, 3_000_000
#: Hashes of the signs for a text's start and end; no word has a zero byte.
START, END, ANY = (np.uint64(HASHES[x]) for x in (b"\x00start", b"\x00end", b"\x00any"))
#: Documents that a pair of words is in, at least, to be told from its second word.
LEAST_PAIR = 50
ORDINARY, TOXIC = 0, 1


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pairs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (before, word) of a text, as hashes: each pair and, with ``ANY`` before it, each word; the end sign is a word."""
    h = HASHES.array(words)
    before, word = np.append(START, h), np.append(h, END)
    pairs = np.unique(np.stack([np.append(before, np.full(len(word), ANY)), np.append(word, word)]), axis=1)
    return pairs[0], pairs[1]


def _discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts, within 0.1 and 0.9."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


class KneserNey:
    """Two models from counts of word pairs; log-probabilities as sums of look-ups.

    ``before``, ``words``: hashes of the pairs; ``counts``: (ordinary, toxic) of each.
    ``own``: the class of the texts to score, if they were counted themselves.
    """

    def __init__(self, before: np.ndarray, words: np.ndarray, counts: np.ndarray, own: int | None = None):
        some = counts.sum(axis=0) > 0
        before, words, counts = before[some], words[some], counts[:, some].astype(np.int64)
        self.known = np.unique(np.concatenate([before, words]))
        size = len(self.known)  # words that aren't known have this number
        v, w = np.searchsorted(self.known, before), np.searchsorted(self.known, words)
        single = before == ANY
        totals = np.stack([np.bincount(w[single], n[single], size + 1) for n in counts])
        key = v * (size + 1) + w
        order = np.flatnonzero(~single & (counts.sum(axis=0) >= LEAST_PAIR))
        order = order[np.argsort(key[order])]
        self.keys, v, w, counts = key[order], v[order], w[order], counts[:, order]
        less = [int(own == c) for c in (ORDINARY, TOXIC)]
        classes = sum((n > x).astype(np.int64) for n, x in zip(totals, less, strict=True))
        types = int((totals.sum(axis=0) > 0).sum())
        d = _discount((totals > 0).sum(axis=0))
        shared = (np.maximum(classes - d, 0) + d * types / (types + 1)) / (totals > 0).sum()
        self.of_pair, self.after, self.alone = [], [], []
        for n, total, x in zip(counts, totals, less, strict=True):
            d = _discount(total)
            alone = (np.maximum(total - x - d, 0) + d * (total > 0).sum() * shared) / total.sum()
            d, seen = _discount(n), np.bincount(v, n, size + 1)
            back = np.where(seen > 0, d * np.bincount(v, n > 0, size + 1) / np.maximum(seen, 1), 1.0)
            pair = np.maximum(n - x - d, 0) / np.maximum(seen[v], 1) + back[v] * alone[w]
            for held, y in ((self.of_pair, pair), (self.after, back), (self.alone, alone)):
                held.append(np.log(y).astype(np.float32))

    def log_probabilities(self, before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of each word's probability in both classes, given numbers of words."""
        key = before * (len(self.known) + 1) + words
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.empty(0, np.int64)
        out = []
        for pair, after, alone in zip(self.of_pair, self.after, self.alone, strict=True):
            x = after[before] + alone[words]
            x[found] = pair[at[found]]
            out.append(x)
        return out[ORDINARY], out[TOXIC]


class Numbers(dict):
    """word -> its number in a model; bounded, for long words aren't kept and it starts anew when full."""

    LIMIT = 250_000

    def __init__(self, known: np.ndarray):
        self.known = known

    def of_hash(self, h: int) -> int:
        k = int(np.searchsorted(self.known, np.uint64(h)))
        return k if k < len(self.known) and self.known[k] == h else len(self.known)

    def __missing__(self, word: bytes) -> int:
        k = self.of_hash(HASHES[word])
        if len(word) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = k
        return k


def evidence(model: KneserNey, numbers: Numbers, texts: list) -> np.ndarray:
    """(mean ordinary log-likelihood, mean toxic one, largest difference of a word) of each text."""
    of_doc = [list(map(numbers.__getitem__, normalised_words(t))) for t in texts]
    sizes = np.array([len(x) + 1 for x in of_doc])
    starts = np.cumsum(sizes) - sizes
    words = np.fromiter((n for x in of_doc for n in (*x, -1)), np.int64, int(sizes.sum()))
    before = np.roll(words, 1)
    words[starts + sizes - 1], before[starts] = numbers.of_hash(END), numbers.of_hash(START)
    ordinary, toxic = (x.astype(np.float64) for x in model.log_probabilities(before, words))
    return np.stack([np.add.reduceat(ordinary, starts) / sizes, np.add.reduceat(toxic, starts) / sizes, np.maximum.reduceat(toxic - ordinary, starts)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights, the bias last, of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * b
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(bend, slope)
        b += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return b


def _inputs(e: np.ndarray) -> np.ndarray:
    return np.column_stack([e[:, 1] - e[:, 0], e[:, 2]])


@dataclass
class Fitted:
    """``model`` and logistic ``weights``, or, without rows of both classes, one score for all."""

    model: KneserNey | None
    weights: np.ndarray | None
    share: float


def _sample(docs: DataFrame, labels: DataFrame, each: int, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Sampled rows (doc_id, text as binary, label, n_words), written, and the number of labels of each class outside the held-out quarter."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(ORDINARY, TOXIC) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("doc_id")))
    )
    first = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for c in (ORDINARY, TOXIC)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def count(batches):
        for b in batches:
            n = pa.array([len(normalised_words(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "n_words"])

    counted = rows.mapInArrow(count, "doc_id long, label int, text binary, n_words long")
    return written(counted, "toxic-sample"), {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}


def _within(sample: DataFrame, words: int, longest: int) -> DataFrame:
    """The rows of each class, by hash of doc_id, that have at most ``words`` words together."""
    sizes = sample.filter(F.col("n_words") <= longest).select("doc_id", "label", "n_words", F.xxhash64("doc_id").alias("h")).collect()  # two numbers a sampled row
    taken, held = [], {ORDINARY: 0, TOXIC: 0}
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        held[r["label"]] += r["n_words"]
        if held[r["label"]] <= words:
            taken.append((r["doc_id"],))
    if len(taken) == len(sizes):
        return sample.filter(F.col("n_words") <= longest)
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id", "left_semi")


def _pairs(rows: DataFrame) -> pa.Table:
    """Hashes of pairs and in how many rows of each class they are: of words alone and of pairs in ``LEAST_PAIR`` rows or more."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                before, words = pairs_of(normalised_words(text))
                mine = [np.full(len(words), int(label == c), np.int32) for c in (ORDINARY, TOXIC)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before.view(np.int64), words.view(np.int64), *mine)], ["before", "word", "ordinary", "toxic"])

    single = int(ANY.view(np.int64))
    return (
        rows.select("label", "text").mapInArrow(count, "before long, word long, ordinary int, toxic int").groupBy("before", "word")
        .agg(F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic"))
        .filter((F.col("before") == single) | (F.col("ordinary") + F.col("toxic") >= LEAST_PAIR)).toArrow()
    )


def _evidence_of(rows: DataFrame, models: list[KneserNey], schema: str) -> DataFrame:
    """The columns of ``rows`` with the evidence of the last one, the text, in its place; scored by the model of the row's label if there are two."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        numbers = [Numbers(m.known) for m in held.value]
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            label = b.column(0).to_pylist() if len(numbers) > 1 else [0] * len(texts)
            out = np.zeros((len(texts), 3))
            for c, model in enumerate(held.value):
                mine = [k for k, x in enumerate(label) if x == c]
                at = 0
                for part in portions([texts[k] for k in mine]):
                    out[mine[at : at + len(part)]] = evidence(model, numbers[c], part)
                    at += len(part)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, out.T.copy())], [*b.schema.names[:-1], *EVIDENCE])

    return rows.mapInArrow(run, schema)


EVIDENCE = ("ordinary_logprob", "toxic_logprob", "largest_difference")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = TRAIN_EACH, words: int = TRAIN_WORDS, longest: int = LONGEST) -> Fitted:
    prepare(docs.sparkSession)
    sample, known = _sample(docs, labels, each, label)
    share = known.get(TOXIC, 0) / sum(known.values()) if known else 0.5
    rows = _within(sample, words, longest)
    table = _pairs(rows)
    before, word = (table.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
    counts = np.stack([table.column(c).to_numpy() for c in ("ordinary", "toxic")])
    if not counts.any(axis=1).all():
        discard(sample)
        return Fitted(None, None, share)
    without = [KneserNey(before, word, counts, own=c) for c in (ORDINARY, TOXIC)]
    got = _evidence_of(rows.select("label", "doc_id", "text"), without, "label int, doc_id long, " + ", ".join(f"{c} double" for c in EVIDENCE)).toArrow()
    discard(sample)
    order = np.argsort(got.column("doc_id").to_numpy())
    y = got.column("label").to_numpy()[order]
    e = np.stack([got.column(c).to_numpy()[order] for c in EVIDENCE], axis=1)
    weight = np.array([known[c] / max(1, int((y == c).sum())) for c in (ORDINARY, TOXIC)])
    return Fitted(KneserNey(before, word, counts), logistic(_inputs(e), y, weight[y]), share)


def score(docs: DataFrame, fitted: Fitted, *keep: str, text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, its mean log-likelihoods, its largest difference of a word and its score in 0..1."""
    prepare(docs.sparkSession)
    if fitted.model is None:
        return docs.select(*keep, *(F.lit(None).cast("double").alias(c) for c in EVIDENCE), F.lit(float(fitted.share)).alias(name))
    rows = docs.select(*keep, F.col(text).cast("binary").alias(own_column(docs, "bytes_of_text")))
    schema = docs.select(*keep)
    for c in EVIDENCE:
        schema = schema.withColumn(c, F.lit(0.0))
    difference, highest, bias = (float(x) for x in fitted.weights)
    said = difference * (F.col("toxic_logprob") - F.col("ordinary_logprob")) + highest * F.col("largest_difference") + bias
    scored = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), said))))
    return _evidence_of(rows, [fitted.model], schema.schema).withColumn(name, scored)
