"""What the operators share: scratch tables, file access, words, hashing."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.scratch import discard, shared_dir, written  # noqa: F401  part of what the operators share

PACKAGE = Path(__file__).resolve().parents[1]
#: ASCII white space; ``bytes.split()`` splits on exactly these.
SPACE = r"[\x20\x09-\x0D]+"
#: Least and most text bytes in one block of documents that a Python task holds at a time; see ``block_bytes``.
BLOCK_BYTES = 8 << 20, 256 << 20
_shipped: set[str] = set()
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on workers and keep Arrow batches small."""
    app = spark.sparkContext.applicationId
    root = str(PACKAGE.parent)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app not in _shipped and root not in on_path:
        archive = Path(tempfile.mkdtemp()) / "stratalake.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in PACKAGE.rglob("*.py"):
                z.write(p, p.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # some texts are very long
    # Else how a scan is split follows the cores there are just now, which change as executors come and go.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(16, spark.sparkContext.defaultParallelism)))
    return spark


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in a store that workers can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def _bytes(said: str) -> int:
    """A size as Spark's settings give it: 4g, 512m, bytes."""
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}
    said = said.strip().lower().removesuffix("b")
    return int(said[:-1]) << unit[said[-1]] if said[-1:] in unit else int(said)


def block_bytes(spark: SparkSession) -> int:
    """Text bytes of a block: what an executor's cores can hold, so larger executors have fewer blocks."""
    conf, (least, most) = spark.sparkContext.getConf(), BLOCK_BYTES
    share = _bytes(conf.get("spark.executor.memory", "1g")) // max(1, int(conf.get("spark.executor.cores", "1")))
    return max(least, min(most, share // 128))


def block_count(docs: DataFrame, column: str = "text") -> int:
    """Blocks of about ``block_bytes`` of text; grows with the input."""
    return max(1, -(-text_bytes(docs, column) // block_bytes(docs.sparkSession)))


def portions(texts: list, most: int = 4 << 20):
    """Runs of texts of about ``most`` bytes together, so that words of few texts are in memory at once."""
    start = held = 0
    for k, t in enumerate(texts, 1):
        held += len(t or b"")
        if held >= most or k == len(texts):
            yield texts[start:k]
            start, held = k, 0


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


def lower_words(text: str | bytes | None) -> list[bytes]:
    """The same with A-Z lower-cased; other letters stay."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def normalised_words(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().translate(_BLANK).split()


#: Longer words are hashed or encoded each time, so that what is remembered is bounded in bytes too.
LONG_WORD = 64


class WordHashes(dict):
    """word -> 64-bit hash; bounded, for long words aren't kept and it starts anew when full."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64)]


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a fixed bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each ``n`` consecutive word hashes, in their order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    if n > 5:  # of two parts, mixed before they meet: no rearrangement of the words has the same hash but by chance
        half = n // 2
        first = ngrams(hashes, half)
        second = first if n == 2 * half else ngrams(hashes, n - half)
        return scramble(first[:m] * _MULTIPLIERS[1] + second[half : half + m] * _MULTIPLIERS[2])
    out = hashes[:m] * _MULTIPLIERS[0]
    for k in range(1, n):
        out += scramble(hashes[k : k + m] + _MULTIPLIERS[k])
    return scramble(out)


def arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def own_column(df: DataFrame, name: str) -> str:
    """``name``, or a longer form that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


if sys.byteorder != "little":  # the file formats below are little-endian
    raise ImportError("a little-endian machine is needed")
