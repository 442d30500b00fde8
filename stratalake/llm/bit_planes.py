"""Operator 1: token ids in files of compressed bit or byte planes.

A file holds the ids of many documents, one after another, in blocks of a
fixed number of ids.  A block is transposed into planes (plane k holds byte k,
or bit k, of every id) and each plane is compressed by itself with zstandard;
planes of zeros take no room.  Layout, little-endian:

    "IDPLANE1"
    planes of block 0, block 1, ...
    document index  zstd(n_docs x (i8 doc_id, i8 n_tokens, u1 id present))
    chunk index     zstd(n_blocks x (u8 offset, u4 n_ids, u4 crc32, u4 length of each plane))
    footer          u8 document index at, u8 chunk index at, u8 n_docs, u8 n_blocks, u8 n_ids,
                    u4 ids in a block, u4 planes, "IDPLANE1"

The chunk index makes every block, hence every id range, readable by itself.

A job range-partitions documents by doc_id, so files are in ascending doc_id
order; each task streams one file into the shared folder under a name of its
own and reports it in a manifest table, which is what makes a file count: a
task that is run again leaves a file that no manifest names.

Rows with equal doc_id are ordered by a hash of the text, then the text; a null
doc_id comes last, and repeated rows are stored as often as they occur.  Null
and empty texts have the end id alone; texts of any length are encoded whole.
Columns other than the id and the text aren't read, whatever their names.  An
empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.common import LONG_WORD, block_count, filesystem, portions, prepare, shared_dir, written

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
_FOOTER = struct.Struct("<QQQQQII8s")
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("present", "u1")])


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of an array of u4."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse; an empty plane stands for zeros."""
    if len(planes) == 4:
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Streams documents into one file; holds at most one block of ids and a compressed index (some bytes a document)."""

    def __init__(self, out, block: int = BLOCK, planes: int = 4, level: int = 3):
        if planes not in (4, 32):
            raise ValueError("planes: 4 (bytes) or 32 (bits)")
        self.out, self.block, self.planes = out, block, planes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.docs: list[tuple[int, int, int]] = []
        self.n_docs, self.index = 0, io.BytesIO()  # entries of the document index, compressed as they come
        self.indexing = zstandard.ZstdCompressor(level=level).stream_writer(self.index, closefd=False)
        self.chunks: list[tuple] = []
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, len(ids), doc_id is not None))
        self.n_docs += 1
        if len(self.docs) == 4096:
            self._index()
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            full = len(ids) // self.block * self.block
            for k in range(0, full, self.block):
                self._chunk(ids[k : k + self.block])
            self.waiting, self.held = [ids[full:]], len(ids) - full

    def _index(self) -> None:
        self.indexing.write(np.array(self.docs, _DOC).tobytes())
        self.docs = []

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) if any(p) else b"" for p in to_planes(ids, self.planes)]
        self.chunks.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *map(len, packed)))
        self._put(b"".join(packed))

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        docs_at = self.at
        self._index()
        self.indexing.close()
        self._put(self.index.getvalue())
        chunks_at = self.at
        self._put(self.zstd.compress(np.array(self.chunks, _chunk_type(self.planes)).tobytes()))
        self._put(_FOOTER.pack(docs_at, chunks_at, self.n_docs, len(self.chunks), self.n_ids, self.block, self.planes, MAGIC))


def _chunk_type(planes: int) -> np.dtype:
    names = [f"p{k}" for k in range(planes)]
    return np.dtype([("at", "<u8"), ("n", "<u4"), ("crc", "<u4"), *((x, "<u4") for x in names)])


class PlaneFile:
    """Reads a file by its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - _FOOTER.size)
        docs_at, chunks_at, n_docs, n_chunks, self.n_ids, self.block, self.planes, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        self.zstd = zstandard.ZstdDecompressor()
        kind = _chunk_type(self.planes)
        self.docs = np.frombuffer(self._at(docs_at, chunks_at - docs_at, n_docs * _DOC.itemsize), _DOC)
        self.chunks = np.frombuffer(self._at(chunks_at, size - _FOOTER.size - chunks_at, n_chunks * kind.itemsize), kind)

    def _at(self, at: int, length: int, most: int) -> bytes:
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(length), max_output_size=max(1, most))

    def chunk(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        lengths = [int(c[f"p{i}"]) for i in range(self.planes)]
        self.source.seek(int(c["at"]))
        raw, planes, n = self.source.read(sum(lengths)), [], int(c["n"])
        for x in lengths:
            planes.append(self.zstd.decompress(raw[:x], max_output_size=n) if x else b"")
            raw = raw[x:]
        ids = from_planes(planes, n)
        if zlib.crc32(ids.tobytes()) != c["crc"]:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file, from the chunks that hold them alone."""
        parts = []
        for k in range(start // self.block, -(-stop // self.block) if stop > start else 0):
            parts.append(self.chunk(k)[max(0, start - k * self.block) : stop - k * self.block])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self):
        """(doc_id or None, start in the file, n_tokens, crc32), with one chunk in memory at a time."""
        k, left, at = -1, np.empty(0, "<u4"), 0
        for doc_id, n, present in self.docs.tolist():
            crc, need = 0, n
            while need:
                if not len(left):
                    k += 1
                    left = self.chunk(k)
                crc = zlib.crc32(left[:need].tobytes(), crc)
                taken = min(need, len(left))
                left, need = left[taken:], need - taken
            yield (doc_id if present else None), at, n, crc
            at += n


class WordEncoder:
    """Ids of texts by a tokenizers file, for one whose tokens never span white space.

    Each distinct word is encoded once a worker and remembered (bounded); a text's
    ids are those of its words, put together.  New words are encoded many at a
    time, joined by spaces, and told apart by offsets.
    """

    REMEMBERED = 1_200_000  # of LONG_WORD bytes at most
    JOINED = 256
    _of: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # A-Z can be lower-cased beforehand where the file does it anyway; but not in what could be read as a special token.
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def words(self, text: bytes) -> list[bytes]:
        if self.lowers:
            low = text.lower()
            if not any(s in low for s in self.special):
                return low.split()
        return text.split()

    def learn(self, new: list[bytes], known: dict[bytes, bytes]) -> None:
        plain = [w.decode("utf-8", "replace") for w in new]
        groups = [range(k, min(k + self.JOINED, len(new))) for k in range(0, len(new), self.JOINED)]
        got = self.tokenizer.encode_batch([" ".join(plain[g.start : g.stop]) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, got, strict=True):
            ids, starts = np.array(e.ids, "<u4"), np.array([o[0] for o in e.offsets], np.int64)
            at = 0
            for k, end in zip(g, np.searchsorted(starts, np.cumsum([len(plain[k]) + 1 for k in g])).tolist(), strict=True):
                known[new[k]] = ids[at:end].tobytes()
                at = end

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [ids for some in portions(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words, known = [self.words(t) for t in texts], self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        new = {w for x in words for w in x}.difference(known)
        self.learn([w for w in new if len(w) <= LONG_WORD], known)
        if long := [w for w in new if len(w) > LONG_WORD]:  # kept for these texts alone
            passing: dict[bytes, bytes] = {}
            self.learn(long, passing)
            return [np.frombuffer(b"".join(known[w] if w in known else passing[w] for w in x), "<u4") for x in words]
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), "<u4") for x in words]


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int, block: int = BLOCK, planes: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into files under the URI ``out``; returns the manifest (part, path, n_docs, n_ids).

    ``tokenizer`` must be a file whose tokens never span white space.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    # By range of doc_id: the text moves once, and the files are in order.  Ranges, and so files, follow the bytes of
    # text; repeated and null ids are told apart by text, so no id fills a range by itself.
    ordered = rows.repartitionByRange(max(1, block_count(rows)), F.asc_nulls_last("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text"))

    def run(batches):
        encoder, writer, end = WordEncoder.of(tokenizer), None, np.array([end_id], "<u4")
        for b in batches:
            if writer is None and b.num_rows:
                files, root = filesystem(out)
                files.create_dir(root)
                part = TaskContext.get().partitionId()
                name = f"part-{part:07d}-{uuid.uuid4().hex}.idp"
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
                writer = PlaneWriter(sink, block, planes)
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode(texts), strict=True):
                writer.add(i, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([f"{out.rstrip('/')}/{name}"]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())],
                ["part", "path", "n_docs", "n_ids"],
            )

    return written(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path) of every document in the files of a manifest."""
    prepare(manifest.sparkSession)
    # One row a file: the running sum over files is far smaller than the ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for i, at, n, crc in PlaneFile(source).documents():
                        rows.append((i, base + at, n, crc, path))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` to id-plane files in the shared folder and return what the files hold."""
    return read(write(docs, tokenizer, shared_dir(docs.sparkSession, "id-planes"), end_id, **options))
