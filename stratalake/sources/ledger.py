"""Versions of a warehouse in a folder: all its tables change together or not at all.

``_versions/<n>.json`` names, for every table of version n, the folders that hold its
rows, its schema and the highest number of each numbered column.  A version never
changes.  A change writes rows and key files into folders of its own, which no version
names yet, and becomes version n + 1 by one rename that fails if n + 1 exists.  So

* readers see the version they opened, whole, whatever is written meanwhile;
* a writer that dies at any step leaves the old version (and folders that ``clean``
  removes), or the new one;
* of two writers that began at the same version, the second is refused (``Conflict``)
  and nothing of it is seen.

Where a store's rename replaces what is there (object stores), a version needs a put
that fails on existing names instead; Hadoop's file systems have the rename.

A change keeps a journal (``_changes/<name>.json``), written after each table is whole.
A run that is begun again under the same name, on the same version, takes over the
tables that its journal names and goes on after them.

Key files.  For every key of a table (primary, UNIQUE) a change also writes, a data
file, the range of the key's first column and a Bloom filter of the whole key, 16 bits
a key in pieces of 4 KB; ``Keys.may_hold`` tells which data files may hold any of some
keys.  Filters are built and read by Spark's own functions, a shuffle of pieces.

Layout.  Rows are written in ranges of the first CREATE INDEX of their table (then of
its key, so that a value of very many rows is spread), else of the key, so ranges of one
folder hardly overlap.  Every index has range files; ``scan`` opens the data files whose
range of an indexed column meets what is asked.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.model import TableSpec

#: Bits of a piece of a Bloom filter (fixed by Spark's bitmap functions), bits a key, and where its three probes begin in a 64-bit hash.
PIECE, BITS_A_KEY, PROBES = 32_768, 16, (19, 34, 49)
#: Rows of a data file at most.
FILE_ROWS = 2_000_000
#: Data files whose ranges are looked up in memory; of more files all are read.
MOST_FILES = 200_000


class Conflict(RuntimeError):
    """Another change became the next version first."""


class Folder:
    """Hadoop's file system under a root, which opens whatever store the cluster uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str, over: bool = False) -> None:
        """Write a small file whole or not at all; FileExistsError if it is there and mustn't be replaced."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self._hadoop.fs
        how = SparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE if over else fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(draft), self._path(name), how)
        except Exception as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise


@dataclass(frozen=True)
class Table:
    """A table in a version: folders below the root, oldest first; schema as JSON; highest numbers given out; keys that have key files; indexed columns."""

    folders: tuple[str, ...]
    schema: str
    marks: dict[str, int] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    ranged: tuple[str, ...] = ()  # indexed columns that have range files
    of: str = ""  # what the rows were made from, if the writer says so

    def said(self) -> dict:
        return {"folders": list(self.folders), "schema": json.loads(self.schema), "marks": self.marks, "keys": [list(k) for k in self.keys], "ranged": list(self.ranged), "of": self.of}


def _table(said: dict) -> Table:
    return Table(tuple(said["folders"]), json.dumps(said["schema"]), dict(said["marks"]), tuple(tuple(k) for k in said["keys"]), tuple(said["ranged"]), said["of"])


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, Table]


class Ledger:
    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.folder, self.file_rows = spark, root.rstrip("/"), Folder(spark, root), file_rows

    def current(self) -> Version:
        """The latest version; number 0, without tables, before the first."""
        numbers = [int(n[:-5]) for n in self.folder.names("_versions") if n.endswith(".json") and n[:-5].isdigit()]
        return self.version(max(numbers)) if numbers else Version(0, {})

    def version(self, number: int) -> Version:
        said = json.loads(self.folder.text(f"_versions/{number:012d}.json"))
        return Version(number, {name: _table(t) for name, t in said["tables"].items()})

    def frame(self, t: Table) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(t.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in t.folders)) if t.folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: Version | None = None) -> DataFrame:
        t = (version or self.current()).tables.get(name)
        if t is None:
            raise FileNotFoundError(f"not saved yet: {name}")
        return self.frame(t)

    def scan(self, name: str, column: str, low, high, version: Version | None = None) -> tuple[DataFrame, int, int]:
        """Rows whose indexed column is low..high, and how many data files are opened for them, of how many."""
        t = (version or self.current()).tables[name]
        rows = self.frame(t)
        inside = F.col(column).between(F.lit(low), F.lit(high))
        if column not in t.ranged or not t.folders:
            return rows.filter(inside), -1, -1
        index = Keys(self, t, (column,))
        places = index._places()
        ranges = index._parts(places, "ranges")
        bound = lambda x: _comparable(rows, column, F.lit(x).cast(rows.schema[column].dataType))
        held = ranges.select("folder", "file", ((F.col("low") <= bound(high)) & (F.col("high") >= bound(low))).alias("meets")).collect()  # one row a file
        paths = [f"{places[r['folder']][0]}/{r['file']}" for r in held if r["meets"]]
        found = self.spark.read.schema(rows.schema).parquet(*paths) if paths else self.spark.createDataFrame([], rows.schema)
        return found.filter(inside), len(paths), len(held)

    def begin(self, name: str | None = None, append: bool = True) -> Change:
        """A change of the current version; with the name of one that didn't end, on the same version, that one goes on."""
        return Change(self, name or uuid.uuid4().hex, append)

    def clean(self, versions: int = 1) -> list[str]:
        """Delete versions but the latest ``versions``, and folders that none of those names; only while nothing writes.  Returns what went."""
        numbers = sorted(int(n[:-5]) for n in self.folder.names("_versions") if n.endswith(".json"))
        kept = numbers[-versions:]
        named = {f.split("/")[1] for n in kept for t in self.version(n).tables.values() for f in t.folders}
        gone = [f"_versions/{n:012d}.json" for n in numbers if n not in kept] + [f"_changes/{n}" for n in self.folder.names("_changes")]
        gone += [f"{part}/{n}" for part in ("_data", "_keys") for n in self.folder.names(part) if n not in named]
        for name in gone:
            self.folder.delete(name)
        return gone


class Change:
    """Tables written for the next version of a ledger."""

    def __init__(self, ledger: Ledger, name: str, append: bool):
        self.ledger, self.name, self.append, self.base = ledger, name, append, ledger.current()
        self.made: dict[str, Table] = {}
        self.kept: dict[str, Table] = {}
        self.id = uuid.uuid4().hex
        journal = f"_changes/{name}.json"
        if ledger.folder.exists(journal):
            said = json.loads(ledger.folder.text(journal))
            if said["base"] == self.base.number and said["append"] == append:
                self.id = said["id"]
                self.made = {n: _table(t) for n, t in said["made"].items()}
                self.kept = {n: _table(t) for n, t in said["kept"].items()}
            else:  # of another version: its rows may not fit any more
                for place in (f"_data/{said['id']}", f"_keys/{said['id']}", journal):
                    ledger.folder.delete(place)

    def _journal(self) -> None:
        said = {"base": self.base.number, "append": self.append, "id": self.id, "made": {n: t.said() for n, t in self.made.items()}, "kept": {n: t.said() for n, t in self.kept.items()}}
        self.ledger.folder.put(f"_changes/{self.name}.json", json.dumps(said), over=True)

    def stored(self, name: str) -> Table | None:
        """The table as the next version goes on with it: what was there, if rows are added."""
        return self.base.tables.get(name) if self.append else None

    def write(self, rows: DataFrame, spec: TableSpec, marks: dict[str, int] | None = None, of: str = "") -> DataFrame:
        """Write a table's rows with its key files; they are whole, and in the journal, when this returns them."""
        if (old := self.stored(spec.name)) and T.StructType.fromJson(json.loads(old.schema)).names != rows.columns:
            raise ValueError(f"{spec.name}: the columns there are others")
        keys = tuple(k for k in dict.fromkeys((spec.primary_key, *(u.columns for u in spec.uniques))) if k and all(c in rows.columns for c in k))
        folder = f"_data/{self.id}/{spec.name}"
        ranged = tuple(dict.fromkeys(x.columns[0] for x in spec.indexes if x.columns[0] in rows.columns and (x.columns[0],) not in keys))
        for place in (folder, *(f"_keys/{self.id}/{_key_folder(spec.name, (c,))}" for c in ranged), *(f"_keys/{self.id}/{_key_folder(spec.name, k)}" for k in keys)):
            self.ledger.folder.delete(place)  # what an earlier try left
        first = next((x.columns for x in spec.indexes if all(c in rows.columns for c in x.columns)), ())
        order = list(dict.fromkeys((*first, *(keys[0] if keys else ()))))
        clustered = rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order) if order else rows
        clustered.write.option("maxRecordsPerFile", self.ledger.file_rows).parquet(f"{self.ledger.root}/{folder}")
        t = Table((folder,), rows.schema.json(), marks or {}, keys, ranged, of)
        written = self.ledger.frame(t)
        if len(spec.primary_key) == 1 and isinstance(rows.schema[spec.primary_key[0]].dataType, T.IntegralType):
            most = written.agg(F.max(spec.primary_key[0])).first()[0]
            t = replace(t, marks={spec.primary_key[0]: most or 0} | (marks or {}))
        for key in keys:
            write_key_files(written, key, f"{self.ledger.root}/_keys/{self.id}/{_key_folder(spec.name, key)}")
        for column in ranged:
            write_key_files(written, (column,), f"{self.ledger.root}/_keys/{self.id}/{_key_folder(spec.name, (column,))}", filters=False)
        self.made[spec.name] = t
        self._journal()
        return written

    def take_over(self, name: str) -> DataFrame:
        """The table stays as it is in the current version."""
        self.kept[name] = self.base.tables[name]
        self._journal()
        return self.ledger.frame(self.kept[name])

    def written(self, name: str) -> DataFrame | None:
        """The rows that this change wrote, or keeps, of a table; none if it hasn't come to it."""
        t = self.made.get(name) or self.kept.get(name)
        return self.ledger.frame(t) if t else None

    def commit(self) -> Version:
        """Make the tables that were written the next version, with all others as they were; ``Conflict`` if another one is."""
        tables = dict(self.base.tables)
        for name, t in self.made.items():
            old = self.stored(name)
            tables[name] = Table((*old.folders, *t.folders), t.schema, {c: max(n, old.marks.get(c, n)) for c, n in (old.marks | t.marks).items()}, tuple(k for k in t.keys if k in old.keys), tuple(c for c in t.ranged if c in old.ranged), t.of) if old else t
        number = self.base.number + 1
        try:
            self.ledger.folder.put(f"_versions/{number:012d}.json", json.dumps({"tables": {n: t.said() for n, t in tables.items()}}))
        except FileExistsError as e:
            raise Conflict(f"version {number} was made by another change") from e
        self.ledger.folder.delete(f"_changes/{self.name}.json")
        return Version(number, tables)

    def abandon(self) -> None:
        for place in (f"_data/{self.id}", f"_keys/{self.id}", f"_changes/{self.name}.json"):
            self.ledger.folder.delete(place)
        self.made, self.kept = {}, {}


# Key files


def _key_folder(table: str, key: tuple[str, ...]) -> str:
    return f"{table}-{hashlib.sha1(json.dumps(key).encode()).hexdigest()[:12]}"


def _hash(columns) -> Column:
    return F.xxhash64(*(F.col(c).cast("string") for c in columns))


def _comparable(rows: DataFrame, column: str, value: Column | None = None) -> Column:
    """The column (or a value of its type) as Python compares it: times as microseconds."""
    kind, value = rows.schema[column].dataType, F.col(column) if value is None else value
    return F.unix_micros(value.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else value


def _piece(h, pieces):
    return F.pmod(h, pieces).cast("int")


def _probe(h, shift: int):
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(PIECE - 1))


def _is_set(bits: Column, p: Column) -> Column:
    """Whether place ``p`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1


def write_key_files(rows: DataFrame, key: tuple[str, ...], path: str, filters: bool = True) -> None:
    """``path``/ranges: (file, n, gaps, pieces, low, high), one row a data file; ``path``/bits: (file, piece, bits) of its Bloom filter.

    Keys with nulls are counted in ``gaps`` and aren't in the filter.
    """
    spark = rows.sparkSession
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    keyed = rows.select(F.col("_metadata.file_name").alias("file"), *key)
    pieces = F.greatest(F.lit(1), F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1), F.count_if(~gap)) * BITS_A_KEY / PIECE)))).cast("long")
    low, high = (f(F.when(~gap, _comparable(rows, key[0]))) for f in (F.min, F.max))
    keyed.groupBy("file").agg(F.count_if(~gap).alias("n"), F.count_if(gap).alias("gaps"), pieces.alias("pieces"), low.alias("low"), high.alias("high")).write.parquet(f"{path}/ranges")
    if not filters:
        return
    ranges = spark.read.parquet(f"{path}/ranges").select("file", "pieces")
    h = F.col("h")
    hashed = keyed.filter(~gap).select("file", _hash(key).alias("h")).join(ranges, "file")
    probes = hashed.select("file", _piece(h, F.col("pieces")).alias("piece"), F.explode(F.array(*(_probe(h, s) for s in PROBES))).alias("p"))
    probes.groupBy("file", "piece").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).write.parquet(f"{path}/bits")


class Keys:
    """The key files of one key of a table in a version."""

    def __init__(self, ledger: Ledger, table: Table, key: tuple[str, ...]):
        self.ledger, self.table, self.key = ledger, table, key
        self.opened = self.files = 0

    def _places(self) -> list[tuple[str, str]]:
        """(data folder, key folder) of each change."""
        root = self.ledger.root
        return [(f"{root}/{f}", f"{root}/_keys/{change}/{_key_folder(name, self.key)}") for f in self.table.folders for _, change, name in [f.split("/")]]

    def _parts(self, places: list[tuple[str, str]], what: str) -> DataFrame:
        parts = [self.ledger.spark.read.parquet(f"{place}/{what}").withColumn("folder", F.lit(k)) for k, (_, place) in enumerate(places)]
        return reduce(DataFrame.unionByName, parts)

    def may_hold(self, keys: DataFrame) -> list[str]:
        """Paths of the data files that may hold any of ``keys`` (columns named as in the table; null equals null)."""
        spark, places = self.ledger.spark, self._places()
        ranges = self._parts(places, "ranges")
        self.files = ranges.count()
        if self.files > MOST_FILES:
            self.opened = self.files
            return [f for f, _ in places]
        held = sorted(ranges.collect(), key=lambda r: (r["folder"], r["n"] == 0, *((r["low"], r["high"]) if r["n"] else ())))  # one row a file, at most MOST_FILES
        schema = T.StructType.fromJson(json.loads(self.table.schema))
        keys = keys.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in self.key))
        asked = keys.select(_comparable(keys, self.key[0]).alias("first"), _hash(self.key).alias("h"), reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.key]).alias("gap"))
        pairs = asked.filter("not gap").select("first", "h").mapInArrow(_in_range([r.asDict() for r in held]), "file_number int, piece int, h long")
        listed = spark.createDataFrame([(k, r["folder"], r["file"]) for k, r in enumerate(held)], "file_number int, folder int, file string")
        every = self._parts(places, "bits").join(F.broadcast(listed), ["folder", "file"]).select("file_number", "piece", "bits")
        probed = pairs.join(every, ["file_number", "piece"])
        for s in PROBES:
            probed = probed.filter(_is_set(F.col("bits"), _probe(F.col("h"), s)))
        found = {r["file_number"] for r in probed.select("file_number").distinct().collect()}  # at most MOST_FILES numbers
        gaps = [k for k, r in enumerate(held) if r["gaps"]]
        if gaps and not asked.filter("gap").isEmpty():
            found |= set(gaps)
        self.opened = len(found)
        return [f"{places[held[k]['folder']][0]}/{held[k]['file']}" for k in sorted(found)]

    def lookup(self, keys: DataFrame, *columns: str) -> DataFrame:
        """The key and ``columns`` of stored rows in files that may hold any of ``keys``; joining is left to the caller."""
        paths = self.may_hold(keys)
        schema = T.StructType.fromJson(json.loads(self.table.schema))
        wanted = list(dict.fromkeys((*self.key, *columns)))
        rows = self.ledger.spark.read.schema(schema).parquet(*paths) if paths else self.ledger.spark.createDataFrame([], schema)
        return rows.select(*wanted)


class Saved:
    """The tables of a version, for rows that are to be added to them."""

    def __init__(self, ledger: Ledger, version: Version):
        self.ledger, self.version = ledger, version
        self.looked: list[tuple[str, str, int, int]] = []  # table, key, files opened, files there

    def table(self, name: str) -> Table | None:
        return self.version.tables.get(name)

    def rows(self, name: str) -> DataFrame:
        return self.ledger.read(name, self.version)

    def last(self, name: str, column: str) -> int:
        """The highest number of a column that was ever saved."""
        t = self.table(name)
        return t.marks.get(column, 0) if t else 0

    def matching(self, name: str, key: tuple[str, ...], keys: DataFrame, *columns: str) -> DataFrame:
        """Key and ``columns`` of the saved rows among which those with any of ``keys`` are; the table's own names for the key are ``key``."""
        t = self.table(name)
        if tuple(key) not in t.keys:
            return self.rows(name).select(*dict.fromkeys((*key, *columns)))
        index = Keys(self.ledger, t, tuple(key))
        out = index.lookup(keys, *columns)
        self.looked.append((name, ", ".join(key), index.opened, index.files))
        return out


def _in_range(held: list):
    """For each asked key the files of each folder whose range holds it: a binary search a folder, over files in order of their lower ends."""

    def run(batches):
        folders: dict[int, list[int]] = {}
        for k, r in enumerate(held):
            folders.setdefault(r["folder"], []).append(k)
        tables = []
        for numbers in folders.values():
            numbers = [k for k in numbers if held[k]["n"]]
            highest, top = [], None
            for k in numbers:
                top = held[k]["high"] if top is None or held[k]["high"] > top else top
                highest.append(top)  # the highest end up to here: before the first place where it reaches a key, no file holds it
            tables.append((numbers, [held[k]["low"] for k in numbers], highest))
        for b in batches:
            out = [], [], []
            for value, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for numbers, lows, highest in tables:
                    for at in range(bisect.bisect_left(highest, value), bisect.bisect_right(lows, value)):
                        k = numbers[at]
                        if held[k]["high"] >= value:
                            out[0].append(k)
                            out[1].append(h % held[k]["pieces"])
                            out[2].append(h)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["file_number", "piece", "h"])

    return run
