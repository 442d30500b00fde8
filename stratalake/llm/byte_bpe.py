"""Operator 10: byte-level BPE with the tokenizers library over Arrow batches.

A rank file (token bytes -> rank) is turned once, on the driver, into a BPE
model of the tokenizers library: each byte is written as one printable
character, and every split of a token into two tokens is a merge at that
token's rank.  Text is cut at ASCII white space into chunks; no match of the
split pattern crosses a chunk's end, so each distinct chunk is encoded once
per worker and the ids are put together.  Texts with other white space are
encoded whole, for there such a cut could change a match.  Chunks of up to
``LONG_CHUNK`` characters are remembered, ``REMEMBERED`` of them and those of
one portion of texts at most.

Decoding reverses the byte table.  A character whose bytes lie in several
tokens is put together across them; bytes that are no UTF-8 become U+FFFD in
``decode_text`` and stay as they are in ``decode_bytes``.

Null text counts as empty; empty text has no ids.  Rows are taken one by one,
so repeated rows and ids give repeated results and texts of any length are
encoded whole; columns other than the id and the text aren't read, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalake.llm.common import portions, prepare

#: Chunks a worker remembers, and characters of the longest; the memory starts anew when full.
REMEMBERED, LONG_CHUNK = 400_000, 64
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers file for ``ranks``."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_characters()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        pairs = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    t = Tokenizer(models.BPE(vocab={name[k]: r for k, r in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    t.decoder = decoders.ByteLevel()
    return t.to_str()


class Codec:
    """Encodes and decodes on a worker."""

    _of: dict[str, "Codec"] = {}

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(model)["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.chunks: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, model: str) -> "Codec":
        key = hashlib.sha1(model.encode()).hexdigest()
        if key not in cls._of:
            cls._of[key] = cls(model)
        return cls._of[key]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for some in portions(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        cut = [[t] if _OTHER_SPACE.search(t) else _CHUNK.findall(t) for t in texts]
        known = self.chunks
        if len(known) > REMEMBERED:
            known.clear()
        passing: dict[str, tuple[int, ...]] = {}  # long chunks are kept for these texts alone
        new = list({c for chunks in cut for c in chunks}.difference(known))
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                (known if len(c) <= LONG_CHUNK else passing)[c] = tuple(e.ids)
        out = []
        for chunks in cut:
            ids: list[int] = []
            for c in chunks:
                ids += known[c] if c in known else passing[c]
            out.append(ids)
        return out

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token starts, and the length."""
        at, out = 0, [0]
        for i in ids:
            at += len(self.bytes_of[i])
            out.append(at)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_pieces(self, ids: list[int]):
        """The characters that each token completes; split characters wait for their last byte."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        yield decoder.decode(b"", True)

    def decode_text(self, ids: list[int]) -> str:
        return "".join(self.decode_pieces(ids))


def _model(spark, ranks_path: str, pattern: str):
    prepare(spark)
    return spark.sparkContext.broadcast(model_json(read_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, starts]) of every row; ``starts`` are byte offsets of the tokens."""
    model = _model(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        codec = Codec.of(model.value)
        for b in batches:
            ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
            got = [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            names = ["doc_id", "n_tokens", "ids"]
            if offsets:
                got.append(pa.array([codec.offsets(x)[:-1] for x in ids], pa.list_(pa.int64())))
                names.append("starts")
            yield pa.RecordBatch.from_arrays(got, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>" + ", starts array<long>" * offsets
    return docs.select(doc_id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text, utf8) of rows with doc_id and ids."""
    model = _model(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        codec = Codec.of(model.value)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(codec.decode_text, ids), pa.string()), pa.array(map(codec.decode_bytes, ids), pa.binary())],
                ["doc_id", "text", "utf8"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string, utf8 binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes, decodes the ids, keeps digests."""
    model = _model(docs.sparkSession, ranks_path, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def run(batches):
        codec = Codec.of(model.value)
        for b in batches:
            rows = []
            for ids in codec.encode([t or "" for t in b.column(1).to_pylist()]):
                listed = str(ids)[1:-1].replace(" ", "")
                digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), codec.decode_bytes(ids)))
                rows.append((len(ids), *digests, *([ids] if keep_ids else ())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
