"""Saving all tables of a warehouse at once, and exporting them for people.

A save writes every table into folders that nobody reads, where it can be checked,
and then makes all of them the next version of the target: see ``sources.ledger``.
"""

from __future__ import annotations

import math
import re
import uuid
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.columns import safe_cell
from stratalake.model import WarehouseModel
from stratalake.scratch import discard, written
from stratalake.sources.ledger import Ledger, Saved

RECREATE, REUSE, APPEND, FAIL = "recreate", "reuse", "append", "fail"
#: Name spaces that nothing is loaded into.
PROTECTED = {"public", "information_schema", "pg_catalog", "pg_toast", "default", "global_temp"}


def slug(value: str, default: str = "use_case", length: int = 55) -> str:
    """Lower-case words joined by underscores; one that starts with a digit gets ``uc_`` before it."""
    name = re.sub(r"[^a-z0-9]+", "_", str(value or "").strip().lower()).strip("_") or default
    if name[:1].isdigit():
        name = f"uc_{name}"
    return name[:length].rstrip("_") or default


def target_namespace(business_name: str, explicit: str | None = None, prefix: str = "") -> str:
    """Where a warehouse is loaded; protected names are refused."""
    start = slug(prefix, default="", length=12) if prefix else ""
    name = slug((explicit or "").strip() or "_".join(x for x in (start, slug(business_name)) if x), length=63)
    if name in PROTECTED or name.startswith("pg_"):
        raise ValueError(f"{name} is a protected name")
    return name


def preflight(spark: SparkSession, root: str, model: WarehouseModel) -> dict[str, bool]:
    """Which tables of the model are saved under ``root``; fails if it can't be written."""
    ledger, probe = Ledger(spark, root), f"_probe-{uuid.uuid4().hex}"
    ledger.folder.put(probe, "")
    ledger.folder.delete(probe)
    tables = ledger.current().tables
    return {t.name: t.name in tables for t in model.tables}


class Stage:
    """Tables written beside their target, not yet part of it."""

    def __init__(self, spark: SparkSession, data: dict[str, DataFrame], model: WarehouseModel, root: str, mode: str = FAIL, name: str | None = None):
        """Write the model's tables, parents first.

        recreate: the tables replace what is there.  reuse: they replace the rows of
        tables that exist and must have the same columns.  append: rows are added.
        fail: none of the tables may have rows yet.  ``data`` may be empty and tables
        written one by one with ``write``; with a ``name`` a run that died goes on.
        """
        if mode not in (RECREATE, REUSE, APPEND, FAIL):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.model, self.mode, self.ledger = spark, model, mode, Ledger(spark, root)
        self.change = self.ledger.begin(name, append=mode == APPEND)
        self.saved = Saved(self.ledger, self.change.base) if mode == APPEND and self.change.base.tables else None
        order = [t.name for t in model.load_order() if t.name in data]
        try:
            for t in order:
                self._admit(t, data[t])
            for t in order:
                self.write(t, data[t])
        except Exception:
            self.drop()
            raise

    def _admit(self, name: str, rows: DataFrame) -> None:
        there = self.change.base.tables.get(name)
        if there and self.mode == FAIL and not self.ledger.frame(there).isEmpty():
            raise FileExistsError(f"{name} has rows already")
        if there and self.mode in (REUSE, APPEND) and self.ledger.frame(there).columns != rows.columns:
            raise ValueError(f"{name}: the columns there are others")

    def write(self, name: str, rows: DataFrame, of: str = "") -> DataFrame:
        """The rows as they were written."""
        self._admit(name, rows)
        return self.change.write(rows, self.model.table(name), of=of)

    def done(self, name: str, of: str = "") -> DataFrame | None:
        """The rows of a table that an earlier try of this run wrote, or that are saved and were made from the same, if the target is replaced."""
        there = self.change.base.tables.get(name)
        if self.change.written(name) is None and of and there and there.of == of and self.mode in (RECREATE, REUSE):
            return self.change.take_over(name)
        return self.change.written(name)

    def tables(self, moved: bool = False) -> dict[str, DataFrame]:
        """What was written; once it is moved, with the rows that were there before."""
        names = {**self.change.made, **self.change.kept}
        return {t: self.ledger.read(t, self.moved) if moved else self.change.written(t) for t in names}

    def drop(self) -> None:
        self.change.abandon()

    def swap(self) -> dict[str, str]:
        """Make the tables part of the target, all of them or none.  Returns where their rows are."""
        change = self.change
        try:
            self.moved = change.commit() if change.made else change.base  # all as it was
        except Exception:
            self.drop()
            raise
        return {t: f"{self.ledger.root}/{x.folders[-1]}" for t, x in {**change.kept, **change.made}.items()}


def save(spark: SparkSession, data: dict[str, DataFrame], model: WarehouseModel, root: str, mode: str = FAIL) -> dict[str, str]:
    """Write the model's tables under ``root``; all of them or none.  Modes as in ``Stage``."""
    return Stage(spark, data, model, root, mode).swap()


def load(spark: SparkSession, model: WarehouseModel, root: str) -> dict[str, DataFrame]:
    """All tables of the model as saved, of one version; an error names those that aren't there."""
    ledger = Ledger(spark, root)
    version = ledger.current()
    if gone := [t.name for t in model.tables if t.name not in version.tables]:
        raise FileNotFoundError(f"not saved yet: {', '.join(gone)}")
    return {t.name: ledger.read(t.name, version).select(*t.column_names) for t in model.tables}


def safe_cells(df: DataFrame) -> DataFrame:
    return df.select(*(safe_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))


#: What the tables of a layer are for.
PURPOSES = {
    "raw_load": "records as their source gave them, with the payload", "staging": "typed and cleaned records", "dimension": "descriptive entities with surrogate keys",
    "fact": "measures of events", "other": "supporting tables",
}
SUMMARY = ["layer", "table", "rows", "columns", "purpose", "keys"]


def summary(data: dict[str, DataFrame], model: WarehouseModel) -> list[tuple[str, str, int, int, str, str]]:
    """Layer, table, rows, columns, purpose and keys of each table, counted in one job."""
    from stratalake.operators.checks import row_counts
    from stratalake.plans.layers import role_of

    counts = {r["table_name"]: r["row_count"] for r in row_counts(data).collect()}
    return [(role_of(t.name), t.name, counts[t.name], len(t.columns), PURPOSES[role_of(t.name)], ", ".join(t.primary_key)) for t in model.tables if t.name in data]


#: Rows below the heading that a sheet can hold.
SHEET_ROWS = 1_048_575
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KINDS, _SHEET = "http://schemas.openxmlformats.org/package/2006/content-types", "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
#: Style 1: headings, bold on a filled ground.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill>'
    '<fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF2F5D62"/></patternFill></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
)


#: Rows of a part of a sheet, which a task writes as a piece of a deflate stream.
PART_ROWS = 50_000
_PART = "task int, number int, rows long, crc long, size long, body binary"


def _deflated(text: str, last: bool = False) -> tuple[int, int, bytes]:
    """(crc32, size, piece of a raw deflate stream); pieces that don't end the stream can be put one after another."""
    z, raw = zlib.compressobj(6, zlib.DEFLATED, -15), text.encode("utf-8", "replace")
    return zlib.crc32(raw), len(raw), z.compress(raw) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _product(a: int, b: int) -> int:
    """Of two polynomials over GF(2) modulo that of crc32, highest power in the lowest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _joined(crc: int, more: int, size: int) -> int:
    """crc32 of two texts one after another, from those of both and the second one's size."""
    shift, step = 1 << 31, 1 << 23  # x**0; x**8, a byte
    while size:
        if size & 1:
            shift = _product(shift, step)
        step, size = _product(step, step), size >> 1
    return _product(shift, crc) ^ more


def _sheet_parts(df: DataFrame, most: int) -> DataFrame:
    """Rows of ``df`` as pieces of sheets, made by the tasks that read them."""

    def run(batches):
        task, number, rows = TaskContext.get().partitionId(), 0, []

        def part():
            crc, size, body = _deflated("".join(rows))
            return pa.RecordBatch.from_pylist([{"task": task, "number": number, "rows": len(rows), "crc": crc, "size": size, "body": body}], schema)

        schema = pa.schema([("task", pa.int32()), ("number", pa.int32()), ("rows", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(_xml_row(values))
                if len(rows) >= most:
                    yield part()
                    number, rows = number + 1, []
        if rows:
            yield part()

    return df.mapInArrow(run, _PART)


class _Workbook:
    """Puts sheets one after another into a zip file; what is in them comes compressed."""

    def __init__(self, z: zipfile.ZipFile, sheet_rows: int):
        self.z, self.sheet_rows, self.names, self.used = z, sheet_rows, [], set()

    def name(self, wanted: str) -> str:
        """A sheet name of 31 characters at most that is not in use."""
        out, k = wanted[:31], 1
        while out.lower() in self.used:
            k += 1
            out = f"{wanted[: 31 - len(str(k)) - 1]}_{k}"
        self.used.add(out.lower())
        self.names.append(out)
        return out

    def sheets(self, wanted: str, columns: list[str], parts, widths: list[int]) -> None:
        """One sheet, or as many as the rows need; ``parts``: (rows, crc, size, body), none of more rows than a sheet."""
        sized = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        head = _deflated(f'{_HEAD}<worksheet xmlns="{_MAIN}">{pane}{f"<cols>{sized}</cols>" if sized else ""}<sheetData>{_xml_row(columns, style=1)}')
        tail = _deflated("</sheetData></worksheet>", last=True)
        left = iter(parts)
        part = next(left, None)
        while True:
            self.name(wanted)
            info = self._open(f"xl/worksheets/sheet{len(self.names)}.xml")
            self._add(info, *head)
            n = 0
            while part is not None and n + part[0] <= self.sheet_rows:
                self._add(info, *part[1:])
                n += part[0]
                part = next(left, None)
            self._add(info, *tail)
            self._close(info)
            if part is None:
                return

    def _open(self, name: str) -> zipfile.ZipInfo:
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        info.compress_type, info.header_offset, info.CRC, info.file_size, info.compress_size = zipfile.ZIP_DEFLATED, self.z.start_dir, 0, 0, 0
        self.z.fp.seek(self.z.start_dir)
        self.z.fp.write(info.FileHeader(zip64=True))
        return info

    def _add(self, info: zipfile.ZipInfo, crc: int, size: int, body: bytes) -> None:
        info.CRC = _joined(info.CRC, crc, size)
        info.file_size += size
        info.compress_size += len(body)
        self.z.fp.write(body)

    def _close(self, info: zipfile.ZipInfo) -> None:
        z, end = self.z, self.z.fp.tell()
        z.fp.seek(info.header_offset)
        z.fp.write(info.FileHeader(zip64=True))  # the sizes are known now
        z.fp.seek(end)
        z.start_dir, z._didModify = end, True
        z.filelist.append(info)
        z.NameToInfo[info.filename] = info

    def close(self) -> None:
        z, ids = self.z, range(1, len(self.names) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEET}.worksheet+xml"/>' for k in ids)
        more = f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET}.styles+xml"/>'
        kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_KINDS}">{kinds}{more}{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(ids, self.names, strict=True))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_REL}">{links}<Relationship Id="rId0" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)


def _read_parts(held: DataFrame):
    """The pieces of a written table in order, a task's at a time."""
    for task in sorted(r["task"] for r in held.select("task").distinct().collect()):  # one number a task
        for r in sorted(held.filter(F.col("task") == task).collect(), key=lambda r: r["number"]):  # compressed pieces of one task
            yield r["rows"], r["crc"], r["size"], r["body"]


def write_xlsx(data: dict[str, DataFrame], model: WarehouseModel, path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook with a summary sheet and the rows of every table, for people to look at.

    Tasks turn their rows into pieces of compressed sheets and write them to the
    shared folder; the driver puts the pieces one after another and writes the zip
    file's directory.  A table of more rows than a sheet can hold goes on in further sheets.
    """
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        book = _Workbook(z, sheet_rows)
        rows = summary(data, model)
        few = [rows[k : k + sheet_rows] for k in range(0, len(rows), sheet_rows)]
        book.sheets("Summary", SUMMARY, ((len(x), *_deflated("".join(map(_xml_row, x)))) for x in few), [14, 32, 12, 12, 56, 32])
        for t in model.tables:
            if t.name in data:
                df = safe_cells(data[t.name])
                held = written(_sheet_parts(df, min(PART_ROWS, sheet_rows)), "sheets")
                book.sheets(t.name, df.columns, _read_parts(held), [max(12, min(36, len(c) + 4)) if not t.has(c) or not t.column(c).is_json else 56 for c in df.columns])
                discard(held)
        book.close()


_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _xml_row(values, style: int = 0) -> str:
    cells, s = [], f' s="{style}"' if style else ""
    for v in values:
        if v is None:
            cells.append("<c/>")
        elif isinstance(v, bool):
            cells.append(f'<c t="b"{s}><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)) and math.isfinite(v):
            cells.append(f"<c{s}><v>{v}</v></c>")
        else:
            cells.append(f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>')
    return f"<row>{''.join(cells)}</row>"


def _markdown(columns: list[str], rows) -> list[str]:
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def _write(path: str, lines: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines).rstrip("\n") + "\n")


def report(title: str, checks: DataFrame, path: str) -> str:
    """A markdown report of check results (one row a check, so bounded by the model) by kind of check; returns the status."""
    from stratalake.operators.checks import status

    said = status(checks).first()["status"]
    rows = checks.orderBy("check_id", "table_name", "columns").collect()
    lines = [f"# {title}", "", f"Status: {said}", "", *_markdown(["kind of check", "checks", "violations"], _by_kind(rows)), "## Checks", "", *_markdown(checks.columns, rows)]
    _write(path, lines)
    return said


def _by_kind(rows) -> list[tuple[str, int, int]]:
    kinds: dict[str, list[int]] = {}
    for r in rows:
        kinds.setdefault(r["check_id"], []).append(r["violations"])
    return [(k, len(v), sum(v)) for k, v in kinds.items()]


def generation_report(path: str, model: WarehouseModel, plan, profile, data: dict[str, DataFrame], assumptions: list | None = None, business: dict | None = None) -> None:
    """What was made: rows by table, lineage, the profile's sizes and relationships, meanings, lists used, limits, what was left out of the schema."""
    from stratalake.plans.semantics import meaning_histogram, meanings, reference_list

    known = meanings(model)
    lists = [(t.name, c.name, got[1]) for t in model.tables for c in t.columns if (got := reference_list(business, t.name, c.name, known[t.name, c.name].kind))]
    limits = [(t.name, c.name, f"{c.base}({c.max_length or f'{c.precision},{c.scale}'})") for t in model.tables for c in t.columns if c.max_length or c.precision]
    lines = ["# Generation", "", *_markdown(SUMMARY, summary(data, model)), "## Lineage", "", *_markdown(["table", "sources", "primary source"], [(t, ", ".join(s), plan.primary.get(t)) for t, s in plan.lineage.items()])]
    if profile:
        sized = [(t, r.category, r.rows, ", ".join(r.staging)) for t, r in profile.raw.items()]
        reused = [(r.child_raw, r.parent_raw, ", ".join(r.child_columns), r.require_reuse) for r in profile.relationships]
        lines += ["## Sizes", "", *_markdown(["raw table", "category", "rows", "feeds"], sized), "## Relationships", "", *_markdown(["child", "parent", "columns", "parents are reused"], reused)]
    keys = [(t.name, ", ".join(f.columns), f"{f.parent}({', '.join(f.parent_columns)})") for t in model.tables for f in t.foreign_keys]
    lines += ["## Foreign keys", "", *_markdown(["table", "columns", "parent"], keys), "## Meanings", "", *_markdown(["meaning", "columns"], meaning_histogram(model).items())]
    lines += ["## Reference lists", "", *_markdown(["table", "column", "list"], lists), "## Lengths and precisions", "", *_markdown(["table", "column", "type"], limits)]
    odd = [(t.name, x) for t in model.tables for x in (*t.ignored, *t.warnings)]
    _write(path, [*lines, "## Left out of the schema", "", *_markdown(["table", "what"], odd), *(["## Assumptions", "", *(f"- {a}" for a in assumptions)] if assumptions else [])])


def load_report(path: str, mode: str, counts: dict[str, int], paths: dict[str, str], reason: str | None = None) -> None:
    """What was saved where, or why nothing was."""
    said = "saved" if paths else "nothing was saved"
    lines = ["# Load", "", f"Status: {said}", f"Mode: {mode}", *([f"Reason: {reason}"] if reason else []), ""]
    _write(path, lines + _markdown(["table", "rows", "path"], [(t, counts.get(t), p) for t, p in paths.items()]))
