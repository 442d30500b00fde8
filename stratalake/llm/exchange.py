"""Exchange of compact messages between blocks of documents and owners of hashes.

Several operators ask something about a hash that needs all documents: how
often a word occurs, which window came first.  Moving one row a word or window
would shuffle many times the input.  Instead

1. each task of a scan cuts its rows into blocks of about ``block_bytes`` of
   text and sends, for each block, one message to each owner: the block's
   distinct hashes in the owner's range, sorted, as compressed binary;
2. an owner merges the messages of its range and answers each block;
3. the answers are written to the shared folder, one file for each scan task,
   and a second scan of the same rows reads the answers for its own blocks.

Text never moves, memory is bounded by a block or by an owner's range, both of
fixed size whatever the input, and a hash in a third of all documents costs an
owner one entry a block at most.

The two scans must cut the same rows into the same blocks.  So ``docs`` must be
a plain table of files (``written`` makes one), and each answer carries the
fingerprint of its block's ids, which the second scan checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import block_bytes, discard, filesystem, shared_dir

MESSAGE = "owner int, part int, block int, mark long, payload binary"
ANSWER = "part int, block int, mark long, payload binary"


class Block:
    """Rows of one block: ids (None for null), texts as UTF-8 (None for null)."""

    def __init__(self, part: int, number: int, ids: list, texts: list):
        self.part, self.number, self.ids, self.texts = part, number, ids, texts
        self.mark = hash(tuple(-1 if i is None else i for i in ids)) & (2**63 - 1)


def blocks(batches, size: int) -> Iterator[Block]:
    """Cut a task's rows (doc_id, text as binary) into blocks of about ``size`` bytes of text."""
    part, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or b"") + 64
            if held >= size:
                yield Block(part, number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield Block(part, number, ids, texts)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; a sorted first array of u8 shrinks to its steps."""
    z, out = zstandard.ZstdCompressor(level=1), [len(arrays).to_bytes(1, "little")]
    for k, a in enumerate(arrays):
        if k == 0 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        body = z.compress(planes)
        head = a.dtype.str.encode()
        out.append(len(head).to_bytes(1, "little") + head + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    z, at, out = zstandard.ZstdDecompressor(), 1, []
    for k in range(data[0]):
        head = data[at]
        kind = np.dtype(data[at + 1 : at + 1 + head].decode())
        at += 1 + head
        n, size = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little")
        raw = z.decompress(data[at + 16 : at + 16 + size], max_output_size=max(1, n * kind.itemsize))
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind)
        out.append(np.cumsum(a, dtype=kind) if k == 0 else a)
        at += 16 + size
    return out


def owners_of(sorted_hashes: np.ndarray, owners: int, bits: int = 64) -> np.ndarray:
    """Where each owner's equal range of hashes of ``bits`` bits starts in a sorted array; the length last."""
    edges = np.array([(k << bits) // owners for k in range(1, owners)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def messages(block: Block, owners: int, hashes: np.ndarray, *more: np.ndarray, bits: int = 64) -> Iterator[tuple]:
    """One message to each owner that has hashes of this block; ``hashes`` are sorted."""
    cuts = owners_of(hashes, owners, bits)
    for k in range(owners):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if b > a:
            yield k, block.part, block.number, block.mark, pack(*(x[a:b] for x in (hashes, *more)))


def send(docs: DataFrame, owners: int, make: Callable[[Block], Iterator[tuple]]) -> DataFrame:
    """The messages that ``make`` yields for each block of ``scan(docs)``."""

    size = block_bytes(docs.sparkSession)

    def run(batches):
        for block in blocks(batches, size):
            rows = list(make(block))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["owner", "part", "block", "mark", "payload"])

    # Few large rows: dealt by owner, each owner's range is one group of bounded size.
    return scan(docs).mapInArrow(run, MESSAGE).repartitionById(owners, "owner")


def answer(sent: DataFrame, own: Callable[[list[tuple[int, int, int, list[np.ndarray]]]], Iterator[tuple]]) -> DataFrame:
    """What owners answer: ``own`` gets (part, block, mark, arrays) of all messages and yields (part, block, mark, payload)."""

    def run(table: pa.Table) -> pa.Table:
        got = [(p, b, m, unpack(x)) for p, b, m, x in zip(*(table.column(c).to_pylist() for c in ("part", "block", "mark", "payload")), strict=True)]
        rows = list(own(got))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "mark", "payload"])

    return sent.groupBy("owner").applyInArrow(run, ANSWER)


class Answers:
    """The answers in the shared folder, for the tasks of a second scan."""

    def __init__(self, answers: DataFrame, label: str, owners: int):
        self.path = shared_dir(answers.sparkSession, label)
        (answers.repartitionById(owners, "part").sortWithinPartitions("part", "block").write.option("compression", "none").partitionBy("part").parquet(self.path))
        self._frame = answers.sparkSession.range(0)
        self._frame._scratch_path = self.path

    def discard(self) -> None:
        discard(self._frame)

    def reader(self) -> Callable[[Block], list[list[np.ndarray]]]:
        path = self.path

        def read(block: Block, held: dict = {}) -> list[list[np.ndarray]]:  # noqa: B006  kept for the task's next block
            if held.get("part") != (path, block.part):
                held.clear()
                held["part"] = (path, block.part)
                held["rows"] = {}
                from pyarrow import fs

                files, root = filesystem(f"{path}/part={block.part}")
                if files.get_file_info(root).type == fs.FileType.Directory:
                    for f in files.get_file_info(fs.FileSelector(root)):
                        if f.path.endswith(".parquet"):
                            with files.open_input_file(f.path) as source:
                                t = pq.read_table(source, columns=["block", "mark", "payload"])
                            for b, m, p in zip(*(c.to_pylist() for c in t.columns), strict=True):
                                held["rows"].setdefault(b, []).append((m, p))
            rows = held["rows"].get(block.number, [])
            if any(m != block.mark for m, _ in rows):
                raise RuntimeError("the second scan cut other blocks than the first: docs must be a plain table of files")
            return [unpack(p) for _, p in rows]

        return read

