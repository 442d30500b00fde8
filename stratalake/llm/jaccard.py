"""Operator 6: exact n-gram Jaccard join with size-banded tiles and bitmap signatures.

A document's set holds the hashes of its distinct word shingles.  Two documents
link if 100 * |intersection| >= 75 * |union|; then the smaller set has at least
75 % of the larger one's size, and the first |x| - ceil(0.75 |x|) + 1 shingles
of both, in any one order of all shingles, share one (prefix filter).

1. Sets are computed once, one narrow row a document: size, digest, bitmap
   signature (two bits or more a shingle, its width set by the size band) and
   prefix.  Documents with equal sets become one class, named by the smallest
   doc_id.  The order puts shingles that a sample shows to be frequent last, so
   boilerplate seldom enters a prefix; it changes the cost, never the result.
2. Owners of shingle hashes gather lists of the classes that share a prefix
   shingle, sorted by size and cut where the next size is beyond the ratio.
   Lists whose smallest member (by a hash) is the same become one tile, so a
   group of near copies, which shares many shingles, is one tile or a few and
   not one a shingle.  A tile of more than ``TILE`` classes or ``MEMBERS``
   shingles is dealt to blocks by hash; see 5.
3. In a tile, bit counts of two signatures bound the overlap from above.
   Classes without a partner that the bound allows leave it: at most as many
   rows come out as went in.
4. The sorted arrays of the others are brought to the tile, and pairs are
   intersected there by falling bound, unless links found before join the two
   already.  Only links that join two components come out: fewer than classes.
5. Tiles of several blocks: first each block by itself, then one class of each
   component of each block, and then, for tiles that still hold more than one
   component, all pairs of blocks, classes of one component left out.
6. Links make components; every document gets its component's smallest doc_id.

A shingle that the sample shows to be in more prefixes than an owner should
hold (``OWNED``) is dealt to several groups and is a tile of its own.

Null and empty texts have an empty set and link with nothing.  A row without
doc_id has no component (null).  Repeated rows and ties are one class; rows of
different texts that share a doc_id are judged by text, and where both are the
smallest of their class they are one node.  Texts of any length are taken
whole; extra columns, whatever their names, are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm import exchange
from stratalake.llm.common import HASHES, discard, lower_words, ngrams, own_column, portions, prepare, scramble, written
from stratalake.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Every ``SAMPLE``-th document tells which shingles are frequent; the most that are remembered (1 MB).
SAMPLE, FREQUENT = 32, 1 << 17
#: Prefix shingles in one owner's range.
OWNED = 1 << 19
#: Most classes, and shingles of them together, in one block of a tile.
TILE, MEMBERS = 4096, 1 << 20
#: Bits a shingle of the signatures that are made inside a tile.
FINE = 16


def shingles(texts: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of each text."""
    return [s for some in portions(texts) for s in _shingles(some, n)]


def _shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    words = [lower_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    h = np.concatenate([HASHES.array(w) for w in words]) if len(words) else np.empty(0, np.uint64)
    grams = ngrams(h, n)  # those that cross a text's end are not used
    out = []
    for k, m, end in zip(range(len(words)), lengths.tolist(), ends.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(grams[end - m : end - n + 1]))
        elif m:
            out.append(scramble(ngrams(h[end - m : end], m) + np.uint64(m)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def links(x: int, y: int, shared: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (x + y - shared)


def signature(s: np.ndarray, rate: int = 2) -> bytes:
    """Bitmap of at least ``rate`` bits a member; a power of two of bits."""
    bits = max(64, 1 << int(rate * len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def bound(nx: int, ny: int, bx: bytes, by: bytes) -> int:
    """The most members that two sets can share, by the bits that one has and the other hasn't."""
    x, y = int.from_bytes(bx, "little"), int.from_bytes(by, "little")
    width = min(len(bx), len(by))
    x, y = _fold(x, len(bx), width), _fold(y, len(by), width)
    return min(nx - (x & ~y).bit_count(), ny - (y & ~x).bit_count())


def _fold(x: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        x = (x >> 8 * width) | (x & ((1 << 8 * width) - 1))
    return x


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the sample in three documents or more, rarest first, and in about how many documents of all; bounded."""

    def run(batches):
        for b in batches:
            got = shingles(b.column(1).to_pylist(), n)
            h, c = np.unique(np.concatenate(got) if got else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])

    sample = exchange.scan(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()[::-1]
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64) * SAMPLE


def sets(docs: DataFrame, n: int, percent: int, ranked: np.ndarray) -> DataFrame:
    """Written (doc_id, n, digest, bits, prefix) of every row; ``ranked``: the shingles that come last in the order."""
    order = np.argsort(ranked)
    held = docs.sparkSession.sparkContext.broadcast((ranked[order], order))

    def run(batches):
        known, rank = held.value
        for b in batches:
            rows = []
            for s in shingles(b.column(1).to_pylist(), n):
                p = prefix_length(len(s), percent)
                prefix = s[:p]
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = known[at] == s
                    if common.any():
                        prefix = np.concatenate([s[~common], s[common][np.argsort(rank[at[common]])]])[:p]
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s) if len(s) else b"", prefix.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n", "digest", "bits", "prefix"])

    return written(exchange.scan(docs).mapInArrow(run, "doc_id long, n int, digest binary, bits binary, prefix binary"), "sets")


def _postings(owners: int, frequent: np.ndarray, about: np.ndarray):
    """Messages (owner, payload of tokens, ids and sizes); frequent tokens go to several owners, others to the one of their range."""
    frequent = scramble(frequent[about > OWNED])
    order = np.argsort(frequent)
    frequent, salts = frequent[order], (about[about > OWNED] // OWNED + 1).astype(np.uint64)[order]

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            # Prefixes are the smallest hashes; scrambled, they spread over all owners.
            tokens = scramble(np.concatenate([x[0] for x in held]))
            ids = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[0]) for x in held])
            ns = np.repeat(np.array([x[2] for x in held], np.int32), [len(x[0]) for x in held])
            salt = np.zeros(len(tokens), np.uint64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                hot = frequent[at] == tokens
                salt[hot] = scramble(ids[hot].view(np.uint64)) % salts[at[hot]]
            rows = []
            for one in np.unique(salt):
                mine = np.flatnonzero(salt == one)
                mine = mine[np.argsort(tokens[mine], kind="stable")]
                cuts = exchange.owners_of(tokens[mine], owners)
                rows += [(k + owners * int(one), exchange.pack(*(x[mine[a:z]] for x in (tokens, ids, ns)))) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["owner", "payload"])

        for b in batches:
            for i, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((np.frombuffer(p, np.uint64), i, n))
                size += len(p)
            if size >= 8 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _lists(percent: int, frequent: np.ndarray, about: np.ndarray):
    """An owner's lists as (tile, class, size): each class once a tile."""
    frequent = scramble(frequent[about > OWNED])

    def run(table: pa.Table) -> pa.Table:
        got = [exchange.unpack(p) for p in table.column("payload").to_pylist()]
        tokens, ids, ns = (np.concatenate([x[k] for x in got]) for k in range(3))
        order = np.lexsort((ids, ns, tokens))
        tokens, ids, ns = tokens[order], ids[order], ns[order].astype(np.int64)
        hot = np.isin(tokens, frequent)
        # A list ends with its shingle, or where the next larger set is too large to link.
        cut = (tokens[1:] != tokens[:-1]) | ((ns[:-1] * 100 < percent * ns[1:]) & ~hot[1:])
        starts = np.flatnonzero(np.r_[True, cut])
        size = np.diff(np.r_[starts, len(tokens)])
        key = np.where(hot[starts], scramble(tokens[starts]), np.minimum.reduceat(scramble(ids.view(np.uint64)), starts))
        several = np.repeat((size > 1) | hot[starts], size)  # most shingles are in one class alone
        rows = np.rec.fromarrays([np.repeat(key, size)[several].view(np.int64), ids[several], ns[several]], names="tile,a,n")
        rows = np.unique(rows)
        return pa.table([pa.array(np.ascontiguousarray(rows[c])) for c in ("tile", "a", "n")], ["tile", "a", "n"])

    return run


def _matrix(bits: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of u8 words of 64 bits, folded to ``width`` bytes."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for k, b in enumerate(bits):
        row = np.frombuffer(b, np.uint64)
        while len(row) > width // 8:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        out[k] = row
    return out


def _allowed(ns: np.ndarray, bits: list[bytes], percent: int):
    """(rows, columns, matrix) of bounds of the overlap of sets sorted by size, -1 where it is too small for a link.

    Each pair is in one matrix, of bounded size, as (smaller or earlier, larger or later).
    """
    widths = np.array([len(b) for b in bits])
    for width in np.unique(widths).tolist():
        # Sizes that can link have signatures of one width or of the next.
        near = np.flatnonzero((widths == width) | (widths == 2 * width))
        m = _matrix([bits[k] for k in near], width)
        count = np.bitwise_count(m).sum(1, dtype=np.int64)
        n, rows = ns[near], np.flatnonzero(widths[near] == width)
        ends = np.searchsorted(n, n * 100 // percent, "right")
        step = max(1, (1 << 21) // max(1, len(near) * m.shape[1]))
        for k in range(0, len(rows), step):
            x = rows[k : k + step]
            y = np.arange(x[0], ends[x].max())
            both = np.bitwise_count(m[x][:, None, :] & m[y][None, :, :]).sum(2, dtype=np.int64)
            most = np.minimum((n[x] - count[x])[:, None], (n[y] - count[y])[None, :]) + both
            most[(100 * most < percent * (n[x][:, None] + n[y][None, :] - most)) | (y[None, :] <= x[:, None])] = -1
            yield near[x], near[y], most


def _rows_of(table: pa.Table, *more: str) -> list:
    """Columns of a tile as arrays, sorted by size and id; of ``more`` as lists."""
    order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("a", "n")))
    out = [table.column(c).to_numpy()[order] for c in ("a", "n", "block", "component")]
    for c in more:
        held = table.column(c).to_pylist()
        out.append([held[k] for k in order])
    return out


def _candidates(percent: int):
    """The classes of a tile that have a partner in another component whom signatures don't rule out."""

    def run(table: pa.Table) -> pa.Table:
        ids, ns, block, comps, bits = _rows_of(table, "bits")
        apart, keep = len(np.unique(block)) > 1, np.zeros(len(ids), bool)
        for x, y, most in _allowed(ns, bits, percent) if len(np.unique(comps)) > 1 else ():
            good = (most >= 0) & (comps[x][:, None] != comps[y][None, :])
            if apart:  # pairs inside a block are settled
                good &= block[x][:, None] != block[y][None, :]
            keep[x] |= good.any(1)
            keep[y] |= good.any(0)
        kept = int(keep.sum())
        same = {c: pa.array([table.column(c)[0].as_py()] * kept, pa.int64()) for c in ("tile", "i", "j")}
        return pa.table(same | {"a": pa.array(ids[keep]), "n": pa.array(ns[keep]), "block": pa.array(block[keep]), "component": pa.array(comps[keep])})

    return run


def _settled(percent: int):
    """The links of a tile that join two components, by exact intersection of sorted arrays."""

    def run(table: pa.Table) -> pa.Table:
        ids, ns, block, comps, sets = _rows_of(table, "s")
        sets = [np.frombuffer(s, np.uint64) for s in sets]
        apart, label, out = len(np.unique(block)) > 1, np.unique(comps, return_inverse=True)[1], []
        for xs, y, most in _allowed(ns, [signature(s, FINE) for s in sets], percent):
            for x, row in zip(xs.tolist(), most, strict=True):
                open_ = np.flatnonzero((row >= 0) & (label[y] != label[x]) & ((block[y] != block[x]) | (not apart)))
                for k in open_[np.argsort(-row[open_], kind="stable")].tolist():
                    other = int(y[k])
                    if label[other] == label[x]:
                        continue
                    both = np.concatenate([sets[x], sets[other]])
                    both.sort(kind="stable")
                    if links(len(sets[x]), len(sets[other]), int((both[1:] == both[:-1]).sum()), percent):
                        label[label == label[other]] = label[x]
                        out.append((int(ids[x]), int(ids[other])))
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _settle(tiles: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Written links of the tiles (tile, i, j, block, a, n, component)."""
    shape = "tile long, i long, j long, a long, n long, block long, component long"
    bits = classes.select(F.col("doc_id").alias("a"), F.col("n").cast("long").alias("n"), "bits")
    left = written(tiles.join(bits, ["a", "n"]).groupBy("tile", "i", "j").applyInArrow(_candidates(percent), shape), "candidates")
    of = classes.select(F.col("doc_id").alias("a"), F.col("n").cast("long").alias("n"), "digest")
    ids = written(of.join(left.select("a", "n").distinct(), ["a", "n"], "left_semi").select(F.col("a").alias("doc_id"), "digest"), "ids")

    def arrays(batches):
        for b in batches:
            got = shingles(b.column(1).to_pylist(), n)
            cols = [pa.array([f(s) for s in got], pa.binary()) for f in (lambda s: xxhash.xxh3_128_digest(s.tobytes()), lambda s: s.tobytes())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "digest", "s"])

    # The written ids have a known size, so Spark itself chooses how they meet the texts.
    whole = exchange.scan(docs).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(arrays, "doc_id long, digest binary, s binary")
    # Rows of other texts under a class's doc_id are no members of it; repeated rows are one.
    whole = whole.join(ids, ["doc_id", "digest"], "left_semi").repartition("doc_id").dropDuplicates(["doc_id", "digest"])
    both = left.join(whole.select(F.col("doc_id").alias("a"), "s"), "a").filter("8 * n <= octet_length(s) and 8 * n >= octet_length(s)")
    found = written(both.groupBy("tile", "i", "j").applyInArrow(_settled(percent), "a long, b long").distinct(), "links")
    discard(left, ids)
    return found


def _labelled(rows: DataFrame, links_found: DataFrame) -> DataFrame:
    """``rows`` (tile, a, n, block, ...) of tiles in more than one component, with each class's component."""
    found = components(links_found)
    named = rows.join(found.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    named = written(named, "labelled")
    open_tiles = named.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("tile")
    return named.join(open_tiles, "tile", "left_semi")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (tile, a, n) with their tile's number of blocks and the block that each is dealt to."""
    sizes = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("members"))
    blocks = F.greatest(F.ceil(F.col("classes") / TILE), F.ceil(F.col("members") / MEMBERS))
    several = sizes.select("tile", blocks.cast("long").alias("blocks")).filter("blocks > 1")
    out = rows.join(several, "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return out.withColumn("block", F.pmod(F.xxhash64("a", F.lit(6)), F.col("blocks")))


def tile_links(rows: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that make the components of all tiles (tile, a, n)."""
    dealt = written(_dealt(rows), "tiles")
    shape = ("tile", "i", "j", "block", "a", "n", "component")
    found = _settle(dealt.withColumns({"i": F.col("block"), "j": F.col("block"), "component": F.col("a")}).select(*shape), classes, docs, n, percent)
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return found
    # One class of each component of each block, so that most tiles become one component.
    few = _labelled(large, found).groupBy("tile", "block", "component").agg(F.min(F.struct("a", "n")).alias("m")).select("tile", "m.a", "m.n", "component")
    few = _dealt(few).withColumns({"i": F.col("block"), "j": F.col("block")}).select(*shape)
    found = found.union(_settle(few, classes, docs, n, percent))
    # What is still apart: every pair of blocks.
    pairs = _labelled(large, found).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("other <> block")
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*shape)
    return found.union(_settle(pairs, classes, docs, n, percent))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    prepare(docs.sparkSession)
    ranked, about = frequent_shingles(docs, n)
    wide = sets(docs, n, percent, ranked)
    known = wide.filter("n > 0 and doc_id is not null")
    groups = written(known.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    named = groups.select(F.col("rep").alias("doc_id"), "digest")
    classes = known.join(named, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    classes = written(classes.select("doc_id", "n", "digest", "bits", "prefix"), "classes")
    every = written(wide.select("doc_id", "n", "digest"), "sets")
    discard(wide)
    total = classes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    owners = max(1, -(-int(total) // OWNED))

    sent = classes.select("doc_id", "n", "prefix").mapInArrow(_postings(owners, ranked, about), "owner int, payload binary")
    rows = sent.repartitionById(owners, "owner").groupBy("owner").applyInArrow(_lists(percent, ranked, about), "tile long, a long, n long")
    rows = written(rows.distinct(), "members")
    found = components(tile_links(rows, classes, docs, n, percent))

    # Only classes of several documents, or with a smaller document in their component, have another name than their own doc_id.
    names = groups.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").filter("copies > 1 or component is not null")
    names = written(names.select("digest", F.coalesce("component", "rep").alias("component")), "names")
    discard(classes, groups)
    return every.join(names, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each component; all columns stay.

    Rows with an empty set or without doc_id stay.
    """
    decided = near_duplicates(docs, n, percent)
    mark = own_column(docs, "gone")
    gone = written(decided.filter("component_id <> doc_id").select(F.col("doc_id").alias(mark)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone[mark], "left_anti")
