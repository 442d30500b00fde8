"""Yinyang k-means, periodic runs and toxicity against brute force, with edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from stratalake.llm import periodic, toxicity, yinyang
from stratalake.llm.common import normalised_words, written

pytest.importorskip("public_tokenizers")


# Yinyang


def plain_kmeans(rows, k, rounds, dims):
    """Full scans over Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]
    distance = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m, strict=True))
    for r in range(rounds + 1):
        own = [min((distance(q, m), j) for j, m in enumerate(c)) for _, q in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [q for (_, q), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in own)
    return sorted(
        ((i, j, d, sum(x for x, y in own if y == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str
    )


def vectors(spark, rows):
    return spark.createDataFrame([(e, i, 3, "x") for i, e in rows], "embedding array<float>, vec_id long, cluster int, q string")


@pytest.mark.parametrize("seed,k,rounds", [(1, 16, 3), (2, 5, 6), (3, 1, 2)])
def test_yinyang_matches_full_scans(spark, seed, k, rounds):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(7, 8)) * 2
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 7] + r.normal(size=8) * 0.3]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(7, [0.5] * 8), (None, [1.0] * 8), (None, [1.0] * 8)]  # copies, equal ids, no id
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 7 + [None]), (2004, [1.0] * 7 + [math.nan]), (2005, [1.0] * 7 + [math.inf])]
    got = [tuple(x) for x in yinyang.report(vectors(spark, rows), k=k, rounds=rounds, dims=8).collect()]
    assert sorted(got, key=str) == plain_kmeans(rows, k, rounds, 8)


def test_bounds_are_kept_and_save_work():
    r = np.random.default_rng(5)
    middles = r.integers(-400, 400, (40, 6))
    q = middles[r.integers(0, 40, 3000)] + r.integers(-20, 20, (3000, 6))
    c, group, work = q[:40].astype(np.int64), None, 0
    group = yinyang.group_centroids(c, 6)
    cluster, upper, lower = yinyang.assign_all(q, c, group)
    for _ in range(6):
        new = np.stack([q[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1))
        c = new
        cluster, upper, lower, n = yinyang.assign_moved(q, c, group, cluster, upper, lower, moved)
        work += n
        d = yinyang.squared(q, c)
        assert (cluster == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(3000), cluster] - 1e-6).all()
        root[np.arange(3000), cluster] = np.inf
        assert all((lower[:, g] <= root[:, group == g].min(axis=1) + 1e-6).all() for g in range(group.max() + 1))
    assert work < 0.5 * 6 * 3000 * 40


def test_yinyang_of_large_few_and_no_vectors(spark):
    big = [(1, [3e38, -3e38]), (2, [1.0, 2.0]), (3, [1e6, -1e6])]
    got = {r["vec_id"]: r for r in yinyang.report(vectors(spark, big), k=2, rounds=1, dims=2).collect()}
    assert len(got) == 3 and all(r["distance"] >= 0 for r in got.values())
    few = yinyang.report(vectors(spark, [(5, [1.0, 1.0]), (6, [2.0, 2.0])]), dims=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(5, 0), (6, 0)]
    none = yinyang.report(vectors(spark, []), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# Periodic runs


def plain_runs(w, least):
    """Every period, every maximal stretch of words that equal those a period on."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_report(i, w):
    runs = plain_runs(w, 12)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic_words(r):
    words = [r.choice("ab") if r.random() < 0.7 else r.choice("abcdef") for _ in range(r.randrange(0, 120))]
    for _ in range(r.randrange(3)):
        if words:
            a, p = r.randrange(len(words)), r.randrange(1, 25)
            n = r.randrange(1, 80)
            words[a : a + n] = [words[min(a + k % p, len(words) - 1)] for k in range(n)]
    return words


@pytest.mark.parametrize("least", [2, 3, 5, 8, 12, 16, 21])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for _ in range(60):
        docs = [periodic_words(r) for _ in range(r.randrange(1, 6))]
        number = {x: k for k, x in enumerate("abcdef")}
        sizes = [len(d) for d in docs]
        names = periodic.Names(np.array([number[x] for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), sizes))
        starts = np.cumsum(sizes) - sizes
        assert list(zip(*(x.tolist() for x in periodic.find_runs(names, least)), strict=True)) == [(s + a, n, q) for a, d in zip(starts.tolist(), docs, strict=True) for s, n, q in plain_runs(d, least)]


def test_periodic_query_matches_brute_force(spark):
    from stratalake.llm.queries import planted_period

    r = random.Random(4)
    rows = [(i, r.choice([" ", "\n", " \t "]).join(periodic_words(r))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "x " * 30), (3, "x y " * 20), (3, "x y " * 20), (403, "une phrase é é " * 9)]
    d = spark.createDataFrame([(t, "a", i, 1) for i, t in rows], "text string, runs string, doc_id long, period int")
    got = sorted((tuple(x) for x in periodic.digests(periodic.periodic_runs(d, edit=planted_period)).collect()), key=str)
    expected = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        expected.append(plain_report(i, w))
    assert got == sorted(expected, key=str)


def test_texts_that_repeat_throughout_stay_cheap(spark):
    long = [(1, "same " * 300_000), (2, " ".join("abcde" * 40_000)), (3, " ".join(str(k * k % 99991) for k in range(200_000)))]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "same"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 200_000, 5)] and got[2]["collapsed"] == "a b c d e"
    assert [tuple(r) for r in got[3]["runs"]] == [(0, 200_000, 99_991)]


def test_periodic_runs_of_an_empty_table(spark):
    d = periodic.digests(periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")))
    assert d.count() == 0 and d.columns[:3] == ["doc_id", "n_runs", "start"]


# Toxicity


def plain_kneser_ney(texts, labels, text, minus=None):
    """Mean log-likelihoods of ``text`` and its largest difference, from dictionaries; ``minus``: the class whose counts are one less."""
    words = lambda t: ["<s>", *(w.decode() for w in normalised_words(t.encode())), "</s>"]
    single, pair = [{}, {}], [{}, {}]
    for t, y in zip(texts, labels, strict=True):
        ws = words(t)
        for w in set(ws[1:]):
            single[y][w] = single[y].get(w, 0) + 1
        for p in set(zip(ws, ws[1:], strict=False)):
            pair[y][p] = pair[y].get(p, 0) + 1
    common = {p for p in {*pair[0], *pair[1]} if pair[0].get(p, 0) + pair[1].get(p, 0) >= toxicity.LEAST_PAIR}

    def discount(counts):
        once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    vocabulary = {*single[0], *single[1]}
    of_class = [(w in single[0]) + (w in single[1]) for w in vocabulary]
    d0 = discount(of_class)
    less = [int(minus == c) for c in (0, 1)]

    def shared(w):
        n = sum(single[c].get(w, 0) > less[c] for c in (0, 1))
        return (max(n - d0, 0) + d0 * len(vocabulary) / (len(vocabulary) + 1)) / sum(of_class)

    def probability(c, v, w):
        d = discount(single[c].values())
        alone = (max(single[c].get(w, 0) - less[c] - d, 0) + d * len(single[c]) * shared(w)) / sum(single[c].values())
        held = {p: n for p, n in pair[c].items() if p in common}
        d = discount(held.values())
        after = [n for p, n in held.items() if p[0] == v]
        if not after:
            return alone
        return max(held.get((v, w), 0) - less[c] - d, 0) / sum(after) + d * len(after) / sum(after) * alone

    ws = words(text)
    logs = [[math.log(probability(c, v, w)) for v, w in zip(ws, ws[1:], strict=False)] for c in (0, 1)]
    return sum(logs[0]) / len(logs[0]), sum(logs[1]) / len(logs[1]), max(b - a for a, b in zip(*logs, strict=True))


def test_models_match_plain_kneser_ney(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_PAIR", 2)
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") if r.random() < 0.8 else f"w{r.randrange(30)}" for _ in range(r.randrange(0, 12))) for _ in range(40)]
    labels = [r.randrange(2) for _ in texts]
    cols = [[], [], []]
    for t, y in zip(texts, labels, strict=True):
        a, b = toxicity.pairs_of(normalised_words(t.encode()))
        for c, x in zip(cols, (a, b, np.full(len(a), y)), strict=True):
            c.append(x)
    a, b, y = map(np.concatenate, cols)
    pairs, where = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    counts = np.stack([np.bincount(where, y == c, pairs.shape[1]) for c in (0, 1)])
    for own in (None, 0, 1):
        model = toxicity.KneserNey(pairs[0], pairs[1], counts, own=own)
        probes = ["", "a", "a b c", "zz a zz yy", texts[3], texts[4] + " q"]
        got = toxicity.evidence(model, toxicity.Numbers(model.known), [t.encode() for t in probes])
        assert np.allclose(got, [plain_kneser_ney(texts, labels, t, own) for t in probes], atol=1e-4)


def toxic_corpus(n=900):
    r = random.Random(6)
    slurs, plain = [f"slur{k}" for k in range(5)], [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.2)
        words = [r.choice(plain) for _ in range(r.choice([8, 40, 400]))]
        for _ in range(r.choice([1, 2, 5]) if y else 0):
            words.insert(r.randrange(len(words)), r.choice([str.lower, str.upper])(r.choice(slurs)) + r.choice(["", "!", ","]))
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_learns_from_some_and_finds_the_others(spark):
    docs, labels = toxic_corpus()
    extra = [(None, "slur1"), (5000, None), (5001, ""), (5002, "slur2 " + "w1 " * 20_000), (3, docs[3][1]), (3, docs[3][1])]
    d = written(spark.createDataFrame([(t, i, 0.5, "x") for i, t in docs + extra], "text string, doc_id long, score double, label string"), "docs")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(d, lab)
    out = toxicity.score(d, fitted, "doc_id", name="toxicity").collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r["toxicity"] <= 1 for r in out)
    truth, held = dict(labels), {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {r["doc_id"]: r["toxicity"] >= 0.3 for r in out if r["doc_id"] in held}
    assert len(held) > 150 and sum(found[i] != truth[i] for i in held) <= 0.02 * len(held)
    assert len({r["toxicity"] for r in out if r["doc_id"] == 3}) == 1
    odd = {r["doc_id"]: r["toxicity"] for r in out if r["doc_id"] in (None, 5000, 5001)}
    assert odd[None] >= 0.3 and odd[5000] == odd[5001] < 0.3


def test_held_out_labels_are_never_learned(spark):
    docs, labels = toxic_corpus(300)
    d = written(spark.createDataFrame(docs, "doc_id long, text string"), "docs")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    runs = [toxicity.score(d, toxicity.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")), "doc_id").orderBy("doc_id").collect() for x in (labels, turned)]
    assert runs[0] == runs[1]


def test_toxicity_without_both_classes_and_of_nothing(spark):
    d = written(spark.createDataFrame([(i, f"a b{i}") for i in range(40)], "doc_id long, text string"), "docs")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(d, toxicity.fit(d, none), "doc_id").collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(d, toxicity.fit(d, one), "doc_id").collect()} == {1.0}
    empty = written(spark.createDataFrame([], "doc_id long, text string"), "docs")
    assert toxicity.score(empty, toxicity.fit(empty, one), "doc_id").count() == 0


def test_the_sample_is_bounded_in_words(spark):
    docs, labels = toxic_corpus(400)
    d = written(spark.createDataFrame(docs, "doc_id long, text string"), "docs")
    sample, known = toxicity._sample(d, spark.createDataFrame(labels, "doc_id long, toxic int"), 50, "toxic")
    assert sample.count() <= 100 and sum(known.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in labels)
    rows = toxicity._within(sample, 2000, 100).collect()
    assert rows and all(r["n_words"] <= 100 for r in rows)
    assert all(sum(r["n_words"] for r in rows if r["label"] == c) <= 2000 for c in (0, 1))
