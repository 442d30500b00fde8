"""Byte-level BPE against the tiktoken library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalake.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", " ", "  a", "a   b", "a  b", "don't 's", "\x1c\x1d!!\x1c", "日本語 テキスト 🙂🙂", "aaaaaaaaaaaa", "é é", "\n\n x\t\ty \n", "12345 67", "---- ====", " x  y", "a\r\nb"]


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = byte_bpe.read_ranks(PATH)
    return byte_bpe.Codec(byte_bpe.model_json(ranks, P.PATTERN)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hard_texts(both):
    codec, other = both
    for t, ids in zip(HARD, codec.encode(HARD), strict=True):
        assert ids == other.encode_ordinary(t), t
        assert codec.decode_text(ids) == t and codec.decode_bytes(ids) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n  ab'sé日🙂1-="), st.characters(codec="utf-8")), max_size=60))
def test_any_text(both, text):
    codec, other = both
    ids = codec.encode([text])[0]
    assert ids == other.encode_ordinary(text) and codec.decode_bytes(ids) == text.encode()


def test_split_characters_are_put_together(both):
    codec, other = both
    ids = [i for b in "🙂é".encode() for i in [codec.tokenizer.token_to_id(byte_bpe.byte_characters()[b])]]
    pieces = list(codec.decode_pieces(ids))
    assert "".join(pieces) == "🙂é" and pieces[0] == "" and codec.offsets(ids)[-1] == 6
    assert codec.decode_text(ids[:2]) == "�"


def test_queries_over_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "long " * 4000)]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(d, PATH, P.PATTERN).collect()}
    assert len(got) == 4 and got[1]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["decoded_sha256"] == hashlib.sha256(("long " * 4000).encode()).hexdigest()
    encoded = byte_bpe.encode(d, PATH, P.PATTERN, offsets=True)
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(encoded, PATH, P.PATTERN).collect()}
    assert back[None] == "x y" and back[1] == ""
    assert byte_bpe.round_trip(d.limit(0), PATH, P.PATTERN).count() == 0


def test_repeated_rows_and_ids_stay(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, "a b")]
    got = byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in got) == sorted((i or 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
