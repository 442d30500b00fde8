"""Decontamination, Jaccard join, repeats, licences, quality and language model against brute force."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import attention, components, decontaminate, jaccard, licenses, lm_score, quality, repeats
from stratalake.llm.common import lower_words, normalised_words, words_of, written

P = pytest.importorskip("public_tokenizers")
VOCABULARY = [f"w{k}" for k in range(400)]


def table(spark, rows):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, source string, component string")
    return written(d, "docs")


def corpus(seed, n=120):
    """Random texts with copies, near copies, shared passages, very short and empty ones."""
    r = random.Random(seed)
    out = []
    passage = [r.choice(VOCABULARY) for _ in range(45)]
    for i in range(n):
        kind = r.random()
        words = [r.choice(VOCABULARY) for _ in range(r.choice([0, 1, 3, 5, 6, 30, 80, 200]))]
        if kind < 0.3 and out:
            words = (r.choice(out)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if words:
                    words[r.randrange(len(words))] = r.choice(VOCABULARY)
        elif kind < 0.5:
            at = r.randrange(len(words) + 1)
            words = words[:at] + passage[r.randrange(5) : 40] + words[at:]
        elif kind < 0.55:
            words = ["same"] * 60
        sep = r.choice([" ", "  ", "\n", " \t"])
        out.append((i * 3, None if kind > 0.98 else sep.join(words)))
    r.shuffle(out)
    return out


# Decontamination


def brute_tiles(p, t, least):
    """Longest common run of unmarked words again and again, earliest first."""
    up, ut, out = [False] * len(p), [False] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not up[i + n] and not ut[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        up[i : i + n], ut[j : j + n] = [True] * n, [True] * n
        out.append((i, j, n))


def test_tiles_match_brute_force():
    r = random.Random(3)
    for _ in range(150):
        p, t = ([r.randrange(6) for _ in range(r.randrange(40))] for _ in range(2))
        cut = r.randrange(1, 30)
        t = t[:10] + p[cut:] + t[10:20] + p[:cut] + t[20:]
        assert sorted(n for *_, n in decontaminate.tiles(p, t, 3)) == sorted(n for *_, n in brute_tiles(p, t, 3))


def test_decontaminate_catches_reordered_items_and_keeps_clean_rows(spark):
    r = random.Random(4)
    item = [r.choice(VOCABULARY) for _ in range(40)]
    noise = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    rows = [
        (1, " ".join(noise(50) + item + noise(50))), (2, ", ".join(w.upper() for w in item[20:] + noise(30) + item[:20])), (3, " ".join(noise(300))),
        (4, " ".join(noise(20) + item[:12])), (5, None), (6, ""), (None, " ".join(item)), (7, " ".join(item[:25])),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, " ".join(noise(30)))], "item_id long, text string")
    d = table(spark, rows)
    hits = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(d, bench).collect()}
    assert set(hits) == {(1, 10), (2, 10), (None, 10), (7, 10)} and hits[2, 10]["tiles"] == 2 and hits[1, 10]["coverage"] == 1
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns and {x["doc_id"] for x in left.collect()} == {3, 4, 5, 6}
    for rows_ in (d, d.limit(0)):  # a benchmark that is joined, not broadcast
        few, many = (decontaminate.annotate(rows_, bench, broadcast_bytes=n) for n in (1 << 20, 10))
        assert few.columns == many.columns and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert decontaminate.contaminated(d.limit(0), bench).count() == 0 and decontaminate.contaminated(d, bench.limit(0)).count() == 0


def test_items_are_looked_for_by_their_rarer_seeds(spark):
    """With a benchmark that is joined a line of many items brings no pairs, and what must be found is."""
    line = " ".join(f"s{k}" for k in range(12))
    items = [(i, " ".join(f"u{i}_{k}" for k in range(30)) + " " + line) for i in range(200)] + [(900, line), (901, "too short")]
    docs = [(d, " ".join(f"x{d}_{k}" for k in range(20)) + " " + line) for d in range(100)] + [(500, items[7][1][:150] + " " + line), (501, items[9][1][:90])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(table(spark, docs), bench, broadcast_bytes=0).collect()
    found = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in got}
    held = decontaminate.annotate(table(spark, docs), bench).collect()
    assert found == {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in held} and found[0] == [900] and found[500] == [7, 900]
    seeds = [(k, len(t.split()), sorted({hash(tuple(t.split()[a : a + 5])) for a in range(len(t.split()) - 4)})) for k, (_, t) in enumerate(items)]
    frame = spark.createDataFrame([(k, [0] * n, s, [hash(tuple(items[k][1].split()[a : a + 5])) for a in range(n - 4)]) for k, n, s in seeds], "item long, words array<long>, seeds array<long>, all_seeds array<long>")
    kept = {}
    for r in decontaminate._needed(frame, 0.5, 5).collect():
        kept.setdefault(r["item"], set()).add(r["seed"])
    shared = {hash(tuple(line.split()[a : a + 5])) for a in range(8)}
    assert all(not kept[k] & shared for k in range(200)) and kept[200] <= shared and 201 not in kept


def test_a_line_that_many_items_share_tiles_none_of_them():
    """Items whose shared words can't reach the threshold aren't tiled; those that can are found as before."""
    import time

    line = " ".join(f"s{k}" for k in range(12))
    items = [(i, " ".join(f"u{i}_{k}" for k in range(30)) + " " + line) for i in range(3000)]
    texts = [(" ".join(f"x{d}_{k}" for k in range(50)) + " " + line + " y").encode() for d in range(40)]
    index = decontaminate.Index(items)
    began = time.perf_counter()
    assert not any(index.batch(texts, 0.5))
    assert (time.perf_counter() - began) / len(texts) < 0.02
    got = index.batch([(items[7][1][:120] + " " + line).encode()], 0.5)[0]
    assert [m["item_id"] for m in got] == [7] and got[0]["tiles"] == 2
    r = random.Random(31)
    for _ in range(60):
        words = [f"w{k}" for k in range(r.choice([5, 12, 60]))]
        some = [(k, " ".join(r.choice(words) for _ in range(r.randrange(5, 40)))) for k in range(8)]
        docs = [" ".join(x for _ in range(3) for it in [r.choice(some)[1].split()] for at in [r.randrange(len(it))] for x in it[at : at + r.randrange(1, 25)]) for _ in range(6)]
        for threshold in (0.3, 0.5, 1.0):
            found = decontaminate.Index(some).batch([t.encode() for t in docs], threshold)
            for t, matches in zip(docs, found, strict=True):
                share = {k: sum(n for _, _, n in brute_tiles(it.split(), t.split(), decontaminate.MIN_TILE)) / len(it.split()) for k, it in some}
                assert {m["item_id"] for m in matches} == {k for k, c in share.items() if c and c >= threshold}


def test_decontaminate_folds_case_of_all_letters(spark):
    item = "Élève à l'école où naît la forêt d'été; señor Núñez así öffnet große Straßen über ǰ"
    texts = [item.upper(), item.lower(), unicodedata.normalize("NFD", item.upper()), unicodedata.normalize("NFD", item), "été où forêt " * 20]
    bench = spark.createDataFrame([(1, item), (2, item.upper())], "item_id long, text string")
    d = table(spark, [(k, f"avant {t} après") for k, t in enumerate(texts)])
    hits = {(x["doc_id"], x["item_id"]): x["coverage"] for x in decontaminate.contaminated(d, bench).collect()}
    assert hits == {(k, i): 1 for k in range(4) for i in (1, 2)}
    assert decontaminate.folded_words(b"\xff\xc3\x89 A-b") == [b"\xff\xc3\xa9", b"a", b"b"]


def brute_contaminated(docs, items, least=5, threshold=0.5):
    out = set()
    for i, t in docs:
        for k, x in items:
            p, w = decontaminate.folded_words(x), decontaminate.folded_words(t)
            if len(p) >= least:
                got = brute_tiles(p, w, least)
                if sum(n for *_, n in got) / len(p) >= threshold:
                    out.add((i, k, sum(n for *_, n in got)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 10])
def test_contaminated_matches_brute_force(spark, broadcast_bytes):
    """Items of few different words, cut and put in another order, in short and in very long texts; repeated rows and clashing names."""
    r = random.Random(12)
    words = lambda n, of=60: [r.choice(VOCABULARY[:of]) for _ in range(n)]
    items = [(k, " ".join(words(r.randrange(3, 40)))) for k in range(12)] + [(3, " ".join(words(20))), (None, " ".join(words(15)))]
    docs = []
    for k in range(60):
        own = r.choice(items)[1].split()
        cuts = sorted(r.sample(range(len(own) + 1), min(len(own), r.randrange(1, 4))))
        parts = [own[a:b] for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True)]
        r.shuffle(parts)
        docs.append((k, " ".join(w for part in parts if r.random() < 0.8 for w in [*words(r.randrange(6)), *part])))
    docs += [(900, " ".join(words(4000, 400) + items[5][1].split() + words(4000, 400))), docs[0], (901, docs[1][1]), (902, None), (903, "")]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, matches string, digest_of_text long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.annotate(d, bench, name="hits", broadcast_bytes=broadcast_bytes)
    got = {(x["doc_id"], m["item_id"]) for x in marked.collect() for m in x["hits"]}
    assert marked.columns == [*d.columns, "hits"] and marked.count() == len(docs)
    assert got == {x[:2] for x in brute_contaminated(docs, items)} and len(got) > 20


# Jaccard join


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("tile,owned", [(4096, 1 << 19), (16, 1 << 19), (8, 40)])
def test_jaccard_of_a_long_list(spark, tile, owned, monkeypatch):
    """Near copies that link in a chain alone, in one tile, in several blocks, and with frequent shingles dealt to several groups."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "OWNED", owned)
    if owned < 1000:
        monkeypatch.setattr(jaccard, "SAMPLE", 1)
    r = random.Random(8)
    base = [r.choice(VOCABULARY) for _ in range(120)]
    rows = [(k, " ".join(base[:60] + base[60 + k :] + base[60 : 60 + k // 4])) for k in range(50)] + [(100 + k, " ".join(base[::-1][k : k + 70])) for k in range(30)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (5, "a b"), (6, "A  b"), (7, "x " * 9000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (0, 1), 2: (0, 2), None: (2, None), 3: (2, 3), 4: (2, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7)}
    d = table(spark, rows)
    kept = jaccard.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7]
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_jaccard_of_very_long_texts(spark):
    """Texts of many different shingles, whole: copies, a near copy of exactly and of just under 0.75, and a short one inside."""
    base = [f"w{k}" for k in range(60_000)]
    shingles = len(base) - 4
    cut = int(shingles * 0.25)  # leaves 75 of 100 shingles, and one less in the next
    rows = [(1, base), (2, base[cut:]), (3, base), (4, base[: int(shingles * 0.74)]), (5, base[100:200])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    share = lambda i: 100 * (len(dict(rows)[i]) - 4) >= 75 * shingles
    assert got == {i: (len(w) - 4, 1 if i in (1, 3) or share(i) else i) for i, w in rows} and got[2][1] == 1 and got[4][1] == 4


def test_signatures_bound_overlap():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([r.choice(x, int(len(x) * r.random())), r.integers(0, 2**63, int(r.integers(1, 60))).astype(np.uint64)]))
        assert jaccard.bound(len(x), len(y), jaccard.signature(x), jaccard.signature(y)) >= len(np.intersect1d(x, y))


@pytest.mark.parametrize("at_once", [200_000, 40])
def test_components_of_chains_and_stars(spark, at_once):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4), at_once=at_once).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {k: 1000 for k in range(1001, 1100)}


# Repeats


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in seen:
                gone[k : k + n] = [True] * n
            seen.add(tuple(w[k : k + n]))
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window,anchor,seed", [(20, 10, 1), (20, 10, 2), (9, 5, 3), (20, 7, 4)])
def test_repeats_match_brute_force(spark, window, anchor, seed):
    r = random.Random(seed)
    long = [r.choice(VOCABULARY) for _ in range(9000)]
    rows = corpus(seed) + [(9001, "z " * 100), (None, "z " * 30), (9002, ""), (9003, " ".join(long)), (9004, " ".join(long[4000:4100] + long[::-1] + long[8000:]))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(table(spark, rows).repartition(3).transform(lambda d: written(d, "docs")), window, anchor).collect()}
    assert got == brute_repeats(rows, window)


def brute_removed(rows, window):
    """doc_id -> kept words: real words of windows, in order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone.update(range(k, k + window))
            seen.add(g)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_words_in_another_order_are_no_repeat(spark):
    r = random.Random(12)
    tail = [f"t{k}" for k in range(16)]
    rows = [["x", "y", "y", "x", *tail], ["y", "x", "x", "y", *tail], tail + ["x", "y", "y", "x"], tail[::-1] + ["x", "y", "y", "x"]]
    base = [f"b{k}" for k in range(20)]
    rows += [base, base[::-1], base[10:] + base[:10], base[1:] + base[:1]]
    for _ in range(60):  # two words only: every weighting of places has rearrangements of equal weight
        rows.append([r.choice("xy") for _ in range(20)])
        rows.append(r.sample(rows[-1], 20))
        rows.append(r.sample(base, 20))
    rows.append(rows[0])
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {x["doc_id"]: x["kept"].split() for x in repeats.remove_repeats(table(spark, docs), texts=True).collect()}
    assert got == brute_removed(docs, 20)
    assert not got[len(docs) - 1] and got[1] == rows[1]


def test_hashes_of_long_windows_differ_by_order():
    from stratalake.llm.common import ngrams

    r = np.random.default_rng(3)
    for n in (6, 7, 10, 13, 20):
        two = r.integers(0, 1 << 63, 2).astype(np.uint64)
        bits = np.unique(r.integers(0, 2, (4000, n)), axis=0)
        got = ngrams(two[bits].ravel(), n)[:: n]
        assert len(np.unique(got)) == len(bits)


def test_repeats_of_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"t{k}" for k in range(25))
    d = spark.createDataFrame([(7, text, "x", 1)] * 3 + [(None, text, "x", 1)] * 2, "doc_id long, text string, kept string, n_words long").coalesce(1)
    got = [(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(written(d, "docs")).collect()]
    assert sorted(got, key=lambda x: (x[0] is None, x)) == [(7, 0), (7, 25), (7, 25), (None, 25), (None, 25)]


def test_repeats_of_nothing_and_texts(spark):
    assert repeats.remove_repeats(table(spark, [])).count() == 0
    text = " ".join(f"t{k}" for k in range(25))
    got = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(table(spark, [(1, text), (2, text + " more")]), texts=True).collect()}
    assert got == {1: text, 2: "more"}


# Licences


def test_licences(spark):
    rows = [
        (1, "See the GNU General-Public License, v3."), (2, "under the Apache License and CC BY 4.0; apache license"), (3, None), (4, ""), (5, "gnu generl public licence text"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining one copy"), (7, "Elle général " * 3000), (8, "mit license"), (None, "the mit licensed"), (9, "redistribution nd use in source and binary form"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows), spans=True).collect()}
    phrases = {k: v for k, v in licenses.BASE.items()}
    for i, t in rows:
        w = [x.decode() for x in normalised_words(t)]
        hits = sorted((k, label) for phrase, label in phrases.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert r["n_words"] == len(w) and r["n_base"] == len(hits) and r["first_word"] == (hits[0][0] if hits else None) and r["last_word"] == (hits[-1][0] if hits else None)
        assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "gpl" in got[5]["labels"] and "mit" in got[6]["labels"] and "bsd" in got[9]["labels"] and got[7]["labels"] == ""
    assert got[5]["spans"][0]["edits"] == 2 and licenses.scan(table(spark, [])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_search_finds_all_notices_within_their_edits():
    r, scanner = random.Random(6), licenses.Scanner()
    for notice, label, k in licenses.NOTICES:
        for _ in range(15):
            s = list(notice)
            for _ in range(r.randrange(k + 1)):
                at = r.randrange(1, len(s) - 1)
                r.choice([lambda at=at: s.pop(at), lambda at=at: s.insert(at, "q"), lambda at=at: s.__setitem__(at, "q")])()
            text = re.sub(" +", " ", "".join(s)).strip()
            if edits(notice, text) <= k:
                found = scanner.fuzzy(["before".encode(), *text.encode().split(), b"after"])
                assert label in {x[3] for x in found}, (notice, text)


def test_notices_with_too_many_edits_get_no_label(spark):
    """One edit more than a notice may have, spread over it; and rows that repeat, very long texts, clashing names."""
    r = random.Random(21)
    rows = []
    for notice, label, k in licenses.NOTICES:
        at = [j for j in range(1, len(notice) - 1) if " " not in notice[j - 1 : j + 2]]
        for _ in range(5):
            s = list(notice)
            for j in r.sample(at, k + 1):
                s[j] = "0"
            near = [x for x, _, m in licenses.NOTICES if any(edits(x, part) <= m for part in ("".join(s), *("".join(s)[a:b] for a in range(len(s)) for b in range(a + len(x) - m, min(len(s), a + len(x) + m) + 1))))]
            if not near and edits(notice, "".join(s)) == k + 1 and not any(phrase in "".join(s) for phrase in licenses.BASE):
                rows.append((len(rows), "".join(s)))
    rows += [rows[0], (900, "filler " * 60_000 + "mit license"), (900, "filler " * 60_000 + "mit license")]
    d = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, labels string")
    got = licenses.scan(d).collect()
    assert len(got) == len(rows) > 30 and {x["labels"] for x in got if x["doc_id"] != 900} == {""}
    assert [(x["first_word"], x["labels"], x["score"]) for x in got if x["doc_id"] == 900] == [(60_000, "mit", 1.0)] * 2


def test_many_near_notices_in_one_text_take_time_in_proportion():
    """Words that belong to no notice keep the parts apart, so the whole text gives what its parts give."""
    import time

    r, scanner = random.Random(21), licenses.Scanner.one()

    def near(notice, edits):
        s = list(notice)
        for _ in range(edits):
            at = r.randrange(len(s))
            s[at : at + 1] = r.choice([[], ["q"], [s[at], "q"]])
        return "".join(s)

    part = [near(licenses.NOTICES[0][0], 2 + k % 3) for k in range(500)]
    alone = [scanner.fuzzy(normalised_words(p)) for p in part]
    took = []
    for copies in (1, 4, 16):
        began = time.perf_counter()
        got = scanner.fuzzy(normalised_words(f" {'z' * 80} ".join(part * copies)))
        took.append(time.perf_counter() - began)
        assert [(e, label) for _, _, e, label, _ in got] == [(e, label) for found in alone * copies for _, _, e, label, _ in sorted(found)]
    assert took[2] < 64 * max(took[0], 0.01)
    began = time.perf_counter()
    assert len(scanner.fuzzy(normalised_words(" ".join(part * 20)))) > 5000  # next to each other, all windows overlap
    assert time.perf_counter() - began < 10


def test_fuzzy_search_finds_adjacent_notices():
    scanner = licenses.Scanner()
    for notice, label, k in licenses.NOTICES:
        one, two = notice[:-2] + "q" + notice[-1], notice[:-3] + "qq" + notice[-1]
        copies = [two, one, notice, one, two, notice] if k > 2 else [one, notice, one, notice]
        words = ["before", *" ".join(copies).split(), "after"]
        at, expected = len("before "), []
        for c in copies:
            expected.append((at, at + len(c), edits(notice, c)))
            at += len(c) + 1
        assert [x[:3] for x in scanner.fuzzy([w.encode() for w in words]) if x[3:] == (label, k) and x[:3] in expected] == expected, notice


# Quality


def test_quality_learns_and_filters(spark):
    r = random.Random(7)
    good = [(k, " ".join(r.choice(VOCABULARY) for _ in range(60)).capitalize() + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(r.choice(VOCABULARY).upper() + "!!" for _ in range(60))) for k in range(100)]
    d = table(spark, good + bad + [(5000, None), (5001, ""), (None, "w1 w2")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7777, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(d, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(d, weights, "doc_id").collect()}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i] >= 0.3) == (i < 1000) for i in held) and all(0 <= s <= 1 for s in got.values()) and len(got) == 403
    sample = quality.training_sample(d, labels, limit=50)
    out = {tuple(quality.features(t)[0].tolist()) for i, t in good + bad if i in set(held)}
    assert len(sample) == 50 and not {tuple(s.tolist()) for s, _, _ in sample} & out
    kept = quality.filter_quality(d, weights)
    assert kept.columns == d.columns and all((x["doc_id"] or 0) < 1000 or x["doc_id"] > 4999 for x in kept.collect())
    assert quality.score(d.limit(0), weights, "doc_id").count() == 0


def plain_features(text):
    """Features as a dict, counted one by one."""
    words = words_of(text)
    shape = lambda w: re.sub(r"[0-9]+", "0", re.sub("(?:[a-z]|[\u00df-\uffff])+", "a", re.sub("[A-Z\u00c0-\u00de]+", "A", w.decode())))
    hash_of = lambda x: np.array([jaccard.HASHES[x]], np.uint64)
    keys = []
    for w in words:
        keys += [quality.scramble(hash_of(w)), quality.scramble(hash_of(b"\x00shape " + shape(w).encode()) + np.uint64(1))]
    for a, b in itertools.pairwise(words):
        keys.append(quality.ngrams(np.concatenate([hash_of(a), hash_of(b)]), 2))
        keys.append(quality.ngrams(np.concatenate([hash_of(b"\x00shape " + shape(x).encode()) for x in (a, b)]), 2))
        if a == b:
            keys.append(np.array([0x5EED], np.uint64))
    counts = {}
    for k in keys:
        slot = int(k[0]) >> (64 - quality.BITS)
        counts[slot] = counts.get(slot, 0) + 1
    length = sum(np.log1p(n) ** 2 for n in counts.values()) ** 0.5
    return {slot: float(np.log1p(n)) / length for slot, n in counts.items()}


def test_quality_matches_plain_ftrl(spark):
    """Features, every step of training and every score again, with dicts and loops alone."""
    r = random.Random(17)
    word = lambda: r.choice([r.choice(VOCABULARY), r.choice(VOCABULARY).upper(), "Été", "a-b9", "x1y22"])
    rows = [(k, " ".join(word() for _ in range(r.randrange(1, 30)))) for k in range(60)] + [(60, "same same same"), (61, ""), (62, None), (63, "w1 " * 5000)]
    labels = [(i, r.randrange(2)) for i, _ in rows] + [(5, 0), (None, 1), (3, None)]
    d = table(spark, [*rows, rows[7], (None, "w1")])
    weights = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    sample = [({**plain_features(dict(rows)[i]), "bias": 1.0}, known[i]) for i in sorted(known)]
    z, n, alpha, beta, l1, l2 = {}, {}, 0.3, 1.0, 0.02, 0.1
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + n[k] ** 0.5) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(sample)):
            x, y = sample[k]
            w = {f: weight(f) for f in x}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                sigma = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha
                z[f], n[f] = z.get(f, 0.0) + g - sigma * w[f], n.get(f, 0.0) + g * g
    got = quality.score(d, weights, "doc_id").collect()
    assert len(got) == len(rows) + 2
    for x in got:
        text = dict(rows).get(x["doc_id"], "w1")
        plain = 1 / (1 + np.exp(-weight("bias") - sum(weight(f) * v for f, v in plain_features(text).items())))
        assert abs(x["score"] - plain) < 1e-4, text


def test_quality_without_labels_and_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b", "s", "m"), (1, "a b", "s", "m")], "doc_id long, text string, score string, label_of_row string")
    weights = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["s"] for x in quality.score(d, weights, "doc_id", name="s").collect()} == {0.5} and quality.filter_quality(d, weights).columns == d.columns
    assert quality.filter_quality(d, weights).count() == 2


# Language model


def test_windows_score_each_id_once():
    lengths = np.array([1, 35, 36, 37, 200])
    sizes = lengths + 1
    starts = np.cumsum(sizes) - sizes
    ids = np.random.default_rng(1).integers(0, 2048, int(sizes.sum())).astype(np.uint16)
    model = attention.Attention.start(np.ones(2048))
    seq, first = attention.windows(lengths)
    *_, target, scored = model.batch(ids, starts, lengths, seq, first)
    assert sorted(target[scored].tolist()) == sorted(set(range(len(ids))) - set(starts.tolist()))
    out = model.score(ids, starts, lengths, at_once=3)
    assert (out[starts] == 0).all() and np.allclose(out, model.score(ids, starts, lengths), atol=1e-3)


def test_model_is_causal_and_a_distribution():
    model, lengths = attention.Attention.start(np.arange(2048) + 1.0), np.array([60])
    ids = np.random.default_rng(2).integers(0, 2048, 61).astype(np.uint16)
    a, changed = model.score(ids, np.array([0]), lengths), ids.copy()
    changed[50:] = 7
    assert np.allclose(a[:50], model.score(changed, np.array([0]), lengths)[:50], atol=1e-4)
    total = 0.0
    for x in range(0, 2048):
        ids[30] = x
        total += np.exp(model.score(ids[:31], np.array([0]), np.array([30]))[30])
    assert abs(total - 1) < 1e-3


def test_each_id_is_scored_with_sixteen_ids_before_it():
    model, n = attention.Attention.start(np.ones(2048)), 200
    ids = np.random.default_rng(3).integers(0, 2048, n + 1).astype(np.uint16)
    score = lambda x: model.score(x, np.array([0]), np.array([n]))
    before = score(ids)
    for at in range(17, n + 1):
        changed = ids.copy()
        changed[at - 16] = (int(ids[at - 16]) + 1000) % 2048
        assert score(changed)[at] != before[at], at


def plain_scores(p, ids):
    """Log probability of each id but the first, by attention written out for one place after another, a window cut for each."""
    out = [0.0]
    for at in range(1, len(ids)):
        first = (at - 1) // attention.STRIDE * attention.STRIDE + attention.STRIDE - attention.WIDTH  # where the window of this place begins
        seen = range(max(0, first), at)
        q = p["q"][ids[at - 1]] + p["qp"][at - 1 - first]
        s = np.array([q @ (p["k"][ids[j]] + p["kp"][j - first]) * attention.KEY**-0.5 for j in seen])
        w = np.exp(s - s.max())
        mixed = (w / w.sum()) @ np.array([p["v"][ids[j]] for j in seen])
        h = np.maximum(mixed + p["e"][ids[at - 1]] + p["b"], 0)
        cls, member = divmod(int(ids[at]), attention.MEMBERS)
        of_class, of_member = h @ p["wc"] + p["bc"], h @ p["wm"][cls] + p["bm"][cls]
        out.append(of_class[cls] - np.log(np.exp(of_class).sum()) + of_member[member] - np.log(np.exp(of_member).sum()))
    return np.array(out)


def test_windows_match_plain_attention():
    r = np.random.default_rng(7)
    model = attention.Attention.start(r.random(2048) + 0.1)
    lengths = np.array([1, 47, 48, 49, 150, 0 + 2])
    sizes = lengths + 1
    starts = np.cumsum(sizes) - sizes
    ids = r.integers(0, 2048, int(sizes.sum())).astype(np.uint16)
    got = model.score(ids, starts, lengths, at_once=4)
    weights = {k: x.astype(np.float64) for k, x in model.p.items()}
    assert np.allclose(got, np.concatenate([plain_scores(weights, ids[a : a + n]) for a, n in zip(starts, sizes, strict=True)]), atol=1e-3)


def test_gradient_against_differences(monkeypatch):
    monkeypatch.setattr(attention, "_F", np.float64)
    ids, starts, lengths = np.random.default_rng(0).integers(0, 2048, 120).astype(np.uint16), np.array([0, 50]), np.array([49, 69])
    model = attention.Attention.start(np.bincount(ids, minlength=2048).astype(float))
    batch = model.batch(ids, starts, lengths, *attention.windows(lengths))
    keys, inside, target, scored = batch
    _, g = model.gradient(keys, inside, ids[target], scored)
    for name, w in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), w.shape)
        old, e = w[at], 1e-5
        w[at] = old + e
        up = model.gradient(keys, inside, ids[target], scored)[0]
        w[at] = old - e
        down = model.gradient(keys, inside, ids[target], scored)[0]
        w[at] = old
        assert abs((up - down) / 2 / e - g[name][at]) < 1e-4 * max(1e-3, abs(g[name][at])) + 1e-8


def test_lm_scores(spark):
    r = random.Random(9)
    words = ["the", "and", "river", "stone", "cloud", "winter", "light"]
    rows = [(k, " ".join(r.choice(words).title() if r.random() < 0.1 else r.choice(words) for _ in range(40))) for k in range(200)] + [(900, None), (901, ""), (None, "the stone"), (903, "zebra é \x00x " * 700)]
    d = table(spark, rows)
    got = {x["doc_id"]: x for x in lm_score.score(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    counts, n = {}, 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for w in [*lower_words(t), None]:
                counts[w], n = counts.get(w, 0) + 1, n + 1
    for i, t in rows:
        w = [*lower_words(t), None]
        base = sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for x in w)
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(w), sum(y in counts for y in w), n) and abs(x["base_score"] - base) < 1e-6 * abs(base)
        assert x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0) and np.isfinite(x["score"]) and x["score"] < 0
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    chosen, weights = lm_score.fit(d, ranks, P.PATTERN)  # deterministic, so the same model
    subwords = lm_score.Subwords(ranks, P.PATTERN, chosen)
    for i in (3, 900, None, 903):
        text = subwords.stream(lower_words(dict(rows)[i])).astype(np.int64)[:3000]
        if i != 903:
            assert abs(got[i]["score"] - plain_scores(weights, text).sum() / np.log(10)) < 1e-3 * max(1, abs(got[i]["score"]))
    again = spark.createDataFrame([(k, "the stone", "x") for k in (5, 5, 15)] + [(5, "the stone", "x")], "doc_id long, text string, score string")
    assert len({tuple(x)[1:] for x in lm_score.score(written(again, "docs"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() if x["doc_id"] == 5}) == 1
    assert lm_score.score(table(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    held = [x for x in got.values() if x["held_out"] and x["n_tokens"] > 5 and x["doc_id"] < 900]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) * 1.2


def test_lm_learns_from_all_training_documents(spark):
    """The sample is one document of other words: ids and weights must come from the rest too."""
    cycle = ["river", "stone", "cloud", "winter", "light", "mountain", "garden", "letter", "window", "market"]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10]
    d = table(spark, [(k, " ".join(cycle * 300)) for k in ids])
    first = d.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").first()[0]
    d = written(d.withColumn("text", F.when(F.col("doc_id") == first, "alpha beta").otherwise(F.col("text"))), "docs")
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    chosen, weights = lm_score.fit(d, ranks, P.PATTERN, most_docs=1)
    subwords = lm_score.Subwords(ranks, P.PATTERN, chosen)
    assert {r for w in cycle for r in subwords.public(w.encode())} <= set(chosen)
    text = np.frombuffer(b"\0\0" + b"".join(subwords.ids(w.encode()) for w in cycle * 3), np.uint16)
    after = attention.Attention(weights).score(text, np.array([0]), np.array([len(text) - 1]))[1:].mean()
    assert after > np.log(1 / len(set(text.tolist()))) + 0.3  # order is learned, beyond shares of ids


def test_joined_pieces_of_all_words_at_once():
    """Pieces joined from public ids shorten streams, and words encoded in one call have the ids they have alone."""
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    words = [(b"thinglyor.", 50), (b"thingea", 40), (b"outionoi", 30), (b"zebra", 1)]
    base = lm_score.Subwords(ranks, P.PATTERN)
    joined = lm_score.join_pieces(words, base, 20)
    subwords = lm_score.Subwords(ranks, P.PATTERN, [], joined)
    subwords.choose({r: n for w, n in words for r in subwords.public(w)})
    odd = [w for w, _ in words] + [b"\xff\xfe", "　a ".encode(), b"\x00", b"a" * 300]
    flat, n = subwords.own(odd)
    assert [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])] == [subwords.ids(w) for w in odd]
    assert n[0] == n[1] == 1 < len(base.public(words[0][0]))
    token = {k: subwords.token[r] for k, r in enumerate(subwords.chosen, 1)}
    assert b"".join(token[k] for k in flat.tolist()) == b"".join(b" " + w.decode("utf-8", "replace").encode() for w in odd)


def test_words_are_coded_as_cut_one_by_one(monkeypatch):
    """Blocks of texts become streams by their distinct words; the same ids as word by word, and what is remembered is bounded."""
    texts = ["The  stone\x0b\x0cTHE ".encode(), None, b"", b" \t\n", "zebra é　É\x1cx\x85 the\x00".encode(), b"\xff\xfe A \xff\xfe", b"x" * 100 + b" the"]
    words, places, n = lm_score.coded_words(texts)
    words = lm_score.as_list(words)
    assert len(set(words)) == len(words) and n.tolist() == [len(lower_words(t)) for t in texts]
    assert [words[k] for k in places] == [w for t in texts for w in lower_words(t)]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    subwords = lm_score.Subwords(ranks, P.PATTERN).choose({r: 5 for r in range(256, 2500)})
    alone = [np.frombuffer(b"\0\0" + b"".join(subwords.ids(w) for w in lower_words(t)) + b"\0\0", np.uint16) for t in texts]
    monkeypatch.setattr(lm_score.Subwords, "REMEMBERED", 3)
    for _ in range(2):
        ids, starts, lengths = subwords.streams(texts)
        assert [ids[a : a + k + 1].tolist() for a, k in zip(starts, lengths, strict=True)] == [x.tolist() for x in alone]
        assert 0 < len(subwords.known) <= 3 and max(map(len, subwords.known)) <= 64
    assert [len(x) for x in subwords.streams([])] == [0, 0, 0]


def test_rows_of_frequent_and_rare_ids_are_added():
    r = np.random.default_rng(3)
    for n in (1, 7, 3000):
        ids, rows = np.minimum(r.geometric(0.05, n), 99).astype(np.uint16), r.normal(size=(n, 6))
        whole = np.zeros((100, 6))
        np.add.at(whole, ids, rows)
        assert np.allclose(attention._add_rows(ids, rows, 100), whole)
