"""Operator 3: WARC bundles of independent Zstandard frames with a seek table.

A bundle is a series of WARC/1.1 records in Zstandard frames, each frame whole
by itself and of about ``FRAME_BYTES``, followed by a skippable frame that
holds the seek table (the seekable format: u4 compressed and decompressed size
of each frame, then u4 count, u1 descriptor, u4 0x8F92EAB1).  The index table
maps each record identifier to its bundle, frame and place in the frame, so
one record is read by decompressing one frame.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the largest page_id is stored (response); the others refer to it (revisit).
Null html counts as empty.  Pages without an id are never referred to; where
no page of a group has an id, all are stored.  Rows that repeat the stored
page's id and payload are stored too.  A page longer than a frame is a frame of its
own, taken whole.  Columns other than page_id, url and html aren't read, whatever
their names.  An empty table gives no bundles and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import filesystem, prepare, shared_dir, written

FRAME_BYTES = 1 << 20
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, path string, frame long, frame_at long, frame_bytes long, record_at long, record_bytes long"


def assign(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    can_match = F.octet_length("payload") >= MIN_REVISIT
    # Aggregated before the shuffle; only payloads that occur again remain.  Written, so that
    # its size is known: small, it is broadcast; large, the join splits the pages of a hot payload.
    stored = rows.filter(can_match).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n"))
    stored = written(stored.filter("n > 1 and stored is not null").select("digest", "stored"), "stored")
    same = F.col("page_id").eqNullSafe(F.col("stored"))
    shape = ("page_id", "url", "payload", "digest")
    large = rows.filter(can_match).join(stored, "digest", "left").select(*shape, F.when(~same, F.col("stored")).alias("refers_to"))
    return large.unionByName(rows.filter(~can_match).select(*shape, F.lit(None).cast("long").alias("refers_to")))


def record(record_id: str, page_url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if page_url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in page_url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    headers = dict(line.split(": ", 1) for line in lines)
    stop = end + 4 + int(headers["Content-Length"])
    return headers, data[end + 4 : stop], stop + 4


class BundleWriter:
    """Streams records into one bundle; holds at most one frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.waiting: list[tuple] = []
        self.raw = self.at = 0

    def add(self, key, data: bytes):
        """Returns the places of the records of a frame that is full now: (key, frame, frame_at, frame_bytes, at, length)."""
        self.waiting.append((key, self.raw, len(data)))
        self.held.append(data)
        self.raw += len(data)
        return self.flush() if self.raw >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        frame = self.zstd.compress(b"".join(self.held))
        self.out.write(frame)
        places = [(key, len(self.sizes), self.at, len(frame), at, n) for key, at, n in self.waiting]
        self.sizes.append((len(frame), self.raw))
        self.at += len(frame)
        self.held, self.waiting, self.raw = [], [], 0
        return places

    def close(self) -> list[tuple]:
        places = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        return places


class Bundle:
    """Reads a bundle frame by frame by its seek table."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * n)
        table = source.read(8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, raw = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=raw)

    def record(self, k: int, at: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(k), at)[:2]

    def records(self):
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parse(data, at)
                yield headers, block


def write(assigned: DataFrame, out: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the records of ``assign`` as bundles under the URI ``out``; returns the written index."""
    prepare(assigned.sparkSession)
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
    names = ["record_id", "page_id", "path", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"]

    def run(batches):
        writer = None

        def index(places):
            rows = [(key[0], key[1], path, *rest) for key, *rest in places]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        count = 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    files, root = filesystem(out)
                    files.create_dir(root)
                    name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.zst"
                    path = f"{out.rstrip('/')}/{name}"
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                rid = f"urn:page:{page}" if page is not None else f"urn:nopage:{name}:{count}"
                count += 1
                if places := writer.add((rid, page), record(rid, url, payload, digest, refers)):
                    yield index(places)
        if writer is not None:
            if places := writer.close():
                yield index(places)
            sink.close()

    return written(assigned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the bundles of an index.

    A stored payload is hashed again and held against its header.
    """
    prepare(index.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None

    def one(headers: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        return number(headers["WARC-Record-ID"]), length, digest, kind, number(headers.get("WARC-Refers-To"))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    rows = []
                    for headers, block in Bundle(source).records():
                        rows.append(one(headers, block))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = index.groupBy("path").agg(F.count(F.lit(1)).alias("records")).select("path")
    return paths.repartition(tasks).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write ``pages`` to bundles in the shared folder and return what the bundles hold."""
    return read(write(assign(pages), shared_dir(pages.sparkSession, "warc"), frame_bytes))
