"""The warehouse model: tables, columns and constraints of a schema text.

Spark's file tables hold no keys or checks, so the model carries them beside
the ``StructType`` and the operators in ``operators.checks`` verify them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class SchemaError(ValueError):
    """The schema text can't be read."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str  # as written, lower case, without surplus blanks
    nullable: bool = True
    default: str | None = None
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None

    @property
    def base(self) -> str:
        return self.type.split("(")[0].strip()

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self)

    @property
    def is_integer(self) -> bool:
        return self.base in INTEGERS

    @property
    def is_numeric(self) -> bool:
        return self.base in NUMBERS

    @property
    def is_json(self) -> bool:
        return self.base in ("json", "jsonb")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    name: str | None = None


@dataclass(frozen=True)
class Index:
    """An index of plain columns; how it is kept is the layout's matter (``sources.ledger``, ``sources.catalog``)."""

    columns: tuple[str, ...]
    unique: bool = False
    name: str | None = None


@dataclass(frozen=True)
class Check:
    """A CHECK; ``op`` is None where it has no form that is evaluated."""

    text: str
    column: str | None = None
    op: str | None = None
    values: tuple[str, ...] = ()
    name: str | None = None

    @property
    def supported(self) -> bool:
        return self.op is not None


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: str | None = None
    columns: tuple[ColumnSpec, ...] = ()
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()
    ignored: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"{self.full_name} has no column {name}")

    def has(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    @property
    def struct(self) -> T.StructType:
        """The Spark schema; what Spark has no place for is in the fields' metadata."""
        out = []
        for c in self.columns:
            facts = {"type": c.type, "default": c.default, "max_length": c.max_length, "primary_key": c.name in self.primary_key}
            out.append(T.StructField(c.name, c.spark_type, c.nullable, {k: v for k, v in facts.items() if v not in (None, False)}))
        return T.StructType(out)


@dataclass(frozen=True)
class WarehouseModel:
    tables: tuple[TableSpec, ...]
    schemas: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    def find(self, name: str) -> TableSpec | None:
        """By bare or qualified name, whatever its case."""
        wanted = name.lower()
        return next((t for t in reversed(self.tables) if wanted in (t.name.lower(), t.full_name.lower())), None)

    def table(self, name: str) -> TableSpec:
        found = self.find(name)
        if found is None:
            raise KeyError(f"unknown table {name}")
        return found

    def load_order(self) -> list[TableSpec]:
        """Parents before children, in the order of the text where that is free.

        An unknown parent, or a cycle (a table that refers to itself is one), is an error.
        """
        waiting = {t.name.lower(): {fk.parent.lower() for fk in t.foreign_keys} for t in self.tables}
        for name, parents in waiting.items():
            if strange := parents - waiting.keys():
                raise SchemaError(f"{name} refers to unknown table {sorted(strange)[0]}")
        done: list[TableSpec] = []
        placed: set[str] = set()
        while waiting:
            ready = [t for t in self.tables if t.name.lower() in waiting and waiting[t.name.lower()] <= placed]
            if not ready:
                raise SchemaError(f"circular foreign keys among {', '.join(sorted(waiting))}")
            for t in ready:
                del waiting[t.name.lower()]
            done += ready
            placed |= {t.name.lower() for t in ready}
        return done


#: Type names of the accepted schema language.
INTEGERS = {"smallint", "smallserial", "integer", "int", "serial", "bigint", "bigserial"}
NUMBERS = {"numeric", "decimal", "double precision", "real", "float"}
STRINGS = {"character varying", "varchar", "character", "char", "text"}
OTHERS = {"uuid", "json", "jsonb", "date", "time", "timestamp", "timestamptz", "timestamp with time zone", "timestamp without time zone", "boolean", "bool"}
TYPES = INTEGERS | NUMBERS | STRINGS | OTHERS

_SIMPLE = {
    "smallint": T.ShortType(), "smallserial": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "serial": T.IntegerType(),
    "bigint": T.LongType(), "bigserial": T.LongType(), "double precision": T.DoubleType(), "float": T.DoubleType(), "real": T.FloatType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamp without time zone": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(),
}


def spark_type(c: ColumnSpec) -> T.DataType:
    """Text, uuid, JSON and time are strings; numeric without digits is decimal(38, 10)."""
    if c.base in ("numeric", "decimal"):
        return T.DecimalType(c.precision, c.scale) if c.precision is not None else T.DecimalType(38, 10)
    return _SIMPLE.get(c.base, T.StringType())


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]


def with_parent_keys(model: WarehouseModel) -> WarehouseModel:
    """Fill in the parent's primary key where a foreign key names no parent columns."""
    tables = []
    for t in model.tables:
        keys = []
        for fk in t.foreign_keys:
            if not fk.parent_columns:
                parent = model.find(fk.parent)
                if parent is None:
                    raise SchemaError(f"{t.full_name} refers to unknown table {fk.parent}")
                if not parent.primary_key:
                    raise SchemaError(f"{t.full_name} refers to {fk.parent}, which has no primary key, without columns")
                if len(parent.primary_key) != len(fk.columns):
                    raise SchemaError(f"{t.full_name}: {len(fk.columns)} columns refer to the {len(parent.primary_key)}-column key of {fk.parent}")
                fk = replace(fk, parent_columns=parent.primary_key)
            keys.append(fk)
        tables.append(replace(t, foreign_keys=tuple(keys)))
    return replace(model, tables=tuple(tables))
