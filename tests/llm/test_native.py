"""Exact dedup, WARC bundles and id planes against brute force, with edge cases."""

import hashlib
import io
import re

import numpy as np
import pytest

from stratalake.llm import bit_planes, exact_dedup, warc

tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [(5, "a  b\tc"), (3, "a b c"), (9, None), (1, ""), (None, "a b\n c"), (7, "x" * 5000), (8, "x" * 5000), (2, " a b c"), (3, "a b c"), (4, " ")]


def docs(spark, rows, extra=True):
    wide = [(i, t, "en", k, 1, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, row long, n long, digest string") if extra else spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_dedup_matches_brute_force(spark):
    got = exact_dedup.exact_duplicates(docs(spark, TEXTS)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(TEXTS)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["keep_id"] == min(ids) and r["group_size"] == len(groups[text])
    assert sum(r["kept"] for r in got) == len(groups)


def test_drop_exact_duplicates_keeps_one_row_a_text_and_all_columns(spark):
    d = docs(spark, TEXTS)
    got = exact_dedup.drop_exact_duplicates(d)
    assert got.columns == d.columns and got.count() == len({re.sub(r"\s+", " ", t or "") for _, t in TEXTS})
    unique = docs(spark, [(1, "a"), (2, "a "), (3, "a"), (4, "b")])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(unique).collect()) == [1, 2, 4]


def test_drop_exact_duplicates_with_clashing_names_and_repeated_ids(spark):
    names = ["_id", "_of", "_kept", "_copies", "_gone", "gone", "digest_of_text", "ID_of_row", "digest_of_row", "best"]
    for rows in (TEXTS, [(1, "a"), (2, "a "), (3, None), (4, "")]):
        d = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
        got = exact_dedup.drop_exact_duplicates(d)
        assert got.columns == d.columns and got.count() == len({re.sub(r"\s+", " ", t or "") for _, t in rows})
    again = [(7, "same"), (7, "same"), (7, "same"), (8, "same"), (None, "same"), (9, "other")]
    d = spark.createDataFrame([(i, t, "x") for i, t in again], "doc_id long, text string, _id string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(d).collect()) == [7, 9]


def test_a_hot_digest_is_found_and_settled(spark):
    d = docs(spark, [(i, "same") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(3000)], extra=False)
    from stratalake.llm.common import written

    table = written(exact_dedup.digests(d), "digests")
    assert len(exact_dedup.frequent(table)) == 1
    got = {r["doc_id"]: r for r in exact_dedup.decide(table).collect()}
    assert got[17]["keep_id"] == 0 and got[17]["group_size"] == 3000 and not got[17]["kept"] and got[0]["kept"] and got[5001]["kept"]


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [], extra=False)).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, [], extra=False)).count() == 0


def test_exact_dedup_of_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(5, long), (2, long.replace(" ", "\n\t")), (7, long + " x"), (7, long + " x"), (9, long[:-1])]
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()}
    assert got == {(5, 2, 2), (2, 2, 2), (7, 7, 2), (9, 9, 1)}


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_are_inverted(planes):
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (bit_planes.from_planes(bit_planes.to_planes(ids, planes), 1000) == ids).all()


@pytest.mark.parametrize("planes", [4, 32])
def test_plane_file_holds_documents_across_blocks(planes):
    out, r = io.BytesIO(), np.random.default_rng(2)
    w = bit_planes.PlaneWriter(out, block=64, planes=planes)
    given = [(k if k % 5 else None, r.integers(0, 49408, n).astype("<u4")) for k, n in enumerate([1, 0, 200, 63, 64, 65, 500])]
    for i, ids in given:
        w.add(i, ids)
    w.close()
    f = bit_planes.PlaneFile(io.BytesIO(out.getvalue()))
    at = 0
    for (i, ids), (j, start, n, crc) in zip(given, f.documents(), strict=True):
        import zlib

        assert (i, at, len(ids), zlib.crc32(ids.tobytes())) == (j, start, n, crc)
        assert (f.ids(at, at + n) == ids).all()
        at += n


def test_id_planes_of_repeated_rows_and_ties(spark):
    """Rows that share an id are all there, one after another; starts run on over them."""
    path = tokenizers.path("word_bpe_49k.json")
    rows = [(4, "b c"), (4, "b c"), (4, "a"), (None, "x"), (None, "x"), (1, "")]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["start"]), r["n_tokens"]) for r in bit_planes.encode_to_files(docs(spark, rows), path).collect())
    assert [k[1] if not k[0] else None for k, _ in got] == [1, 4, 4, 4, None, None]
    at = 0
    for (_, _, start), n in got:
        assert start == at
        at += n


def test_id_planes_query(spark):
    import zlib

    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rows = [(3, "Hello <|endoftext|> wörld"), (1, None), (2, ""), (None, "it's İ ΣΑΣ"), (9, "word " * 3000), (4, "école   x")]
    got = {r["doc_id"]: r for r in bit_planes.encode_to_files(docs(spark, rows), path).collect()}
    t, at = Tokenizer.from_file(path), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bit_planes.encode_to_files(docs(spark, [], extra=False), path).count() == 0


def test_warc_bundles(spark):
    long, other = "p" * 1200, "ü" * 700
    rows = [(1, "u1", long), (5, "u5", long), (3, None, long), (2, "u2", "short"), (4, "u\n4", "short"), (6, "u", None), (None, "n", long), (7, "v", other), (7, "v", other), (8, "w" * 9, "q" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(warc.archive_pages(pages, frame_bytes=4096).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert len(got) == len(rows)
    for r, (i, _, h) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        body = (h or "").encode()
        assert r["page_id"] == i and r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        revisit = h == long and i != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))


def test_a_page_longer_than_a_frame_and_a_hot_payload(spark):
    rows = [(k, "u", "h" * 3000) for k in range(200)] + [(500, "u", "ä" * 3_000_000), (501, "u", "short"), (502, "u", "short"), (503, "u", "ä" * 500), (504, "u", "ä" * 499)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == len(rows) and got[500]["payload_bytes"] == 6_000_000 and got[500]["payload_digest"] == hashlib.sha1(("ä" * 3_000_000).encode()).hexdigest()
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 199) if i < 199 else ("response", None)) for i, r in got.items())


def test_one_record_is_found_by_the_index(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(300)], "page_id long, url string, html string")
    from stratalake.llm.common import filesystem, shared_dir

    index = warc.write(warc.assign(pages), shared_dir(spark, "warc"), frame_bytes=8192)
    row = index.filter("page_id = 123").first()
    files, name = filesystem(row["path"])
    with files.open_input_file(name) as f:
        headers, block = warc.Bundle(f).record(row["frame"], row["record_at"])
    assert headers["WARC-Record-ID"] == "<urn:page:123>" and block.endswith(b"<p>123</p>" * 50)
    assert warc.archive_pages(pages.limit(0)).count() == 0
