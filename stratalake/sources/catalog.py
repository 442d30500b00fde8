"""Tables of a model in Spark's catalog.

The catalog's file tables take types, NOT NULL and literal defaults; keys and
checks stay in the model, where ``operators.checks`` verifies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.model import TableSpec, WarehouseModel
from stratalake.scratch import discard, written
from stratalake.sources.sinks import APPEND, FAIL, RECREATE, target_namespace


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucket_columns(model: WarehouseModel) -> dict[str, tuple[str, ...]]:
    """What each table is bucketed by, so that joins along foreign keys need no shuffle.

    A parent by the key that is referred to, a child by the foreign key that is part of
    its primary key, else by its first one; both only where types are equal and neither
    is bucketed for another relation already.  Children come first: their joins move more rows.
    """
    out: dict[str, tuple[str, ...]] = {}
    for t in reversed(model.load_order()):
        if t.name in out:
            continue
        for fk in sorted(t.foreign_keys, key=lambda f: not set(f.columns) <= set(t.primary_key)):
            parent = model.table(fk.parent)
            alike = all(t.column(c).spark_type == parent.column(p).spark_type for c, p in zip(fk.columns, fk.parent_columns, strict=True))
            if alike and out.get(parent.name, fk.parent_columns) == fk.parent_columns:
                out[t.name], out[parent.name] = fk.columns, fk.parent_columns
                break
    return out


def create_statement(t: TableSpec, namespace: str | None = None, by: tuple[str, ...] = (), buckets: int = 0) -> str:
    """CREATE TABLE of a table as Parquet, in ``buckets`` by ``by``; what was declared and can't be held is in the comment."""
    columns = ", ".join(f"{_quoted(c.name)} {c.spark_type.simpleString()}{'' if c.nullable else ' NOT NULL'}" for c in t.columns)
    kept = [f"PRIMARY KEY ({', '.join(t.primary_key)})"] if t.primary_key else []
    kept += [f"UNIQUE ({', '.join(u.columns)})" for u in t.uniques] + [f"CHECK ({c.text})" for c in t.checks]
    kept += [f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.parent} ({', '.join(f.parent_columns)})" for f in t.foreign_keys]
    said = "; ".join(kept).replace("\\", "\\\\").replace("'", "\\'")
    comment = f" COMMENT '{said}'" if kept else ""
    said_by = ", ".join(map(_quoted, by))
    clustered = f" CLUSTERED BY ({said_by}) SORTED BY ({said_by}) INTO {buckets} BUCKETS" if by and buckets else ""
    where = f"{_quoted(namespace)}.{_quoted(t.name)}" if namespace else _quoted(t.name)
    return f"CREATE TABLE IF NOT EXISTS {where} ({columns}) USING parquet{clustered}{comment}"


def existing(spark: SparkSession, model: WarehouseModel, namespace: str) -> dict[str, bool]:
    return {t.name: spark.catalog.tableExists(f"{namespace}.{t.name}") for t in model.tables}


def drop(spark: SparkSession, namespace: str) -> None:
    """Drop a namespace with its tables; protected ones are refused."""
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(target_namespace('', explicit=namespace))} CASCADE")


def publish(spark: SparkSession, data: dict[str, DataFrame], model: WarehouseModel, namespace: str, mode: str = FAIL, buckets: int = 0) -> list[str]:
    """Write the model's tables into a namespace, parents first; returns their names.

    Modes as in ``sinks.Stage``.  All rows are written to the shared folder before
    anything of the namespace is dropped or replaced, so frames may read from it.
    With ``buckets`` tables are laid out by ``bucket_columns``, one file a bucket and save.
    The catalog has no transaction over tables: where all-or-nothing matters, save
    to a folder with ``sinks.save``.
    """
    namespace = target_namespace("", explicit=namespace)
    order = [t for t in model.load_order() if t.name in data]
    there = existing(spark, model, namespace)
    if mode == FAIL and (full := [t.name for t in order if there[t.name] and not spark.table(f"{namespace}.{t.name}").isEmpty()]):
        raise FileExistsError(f"{', '.join(full)} has rows already")
    rows = {t.name: written(data[t.name].select(*t.column_names), t.name) for t in order}
    if mode == RECREATE:
        drop(spark, namespace)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(namespace)}")
    layout = bucket_columns(model) if buckets else {}
    for t in order:
        by = layout.get(t.name, ())
        spark.sql(create_statement(t, namespace, by, buckets))
        (rows[t.name].repartition(buckets, *by) if by else rows[t.name]).write.insertInto(f"{namespace}.{t.name}", overwrite=mode != APPEND)
    discard(*rows.values())
    return [f"{namespace}.{t.name}" for t in order]


def read_back(spark: SparkSession, model: WarehouseModel, namespace: str) -> dict[str, DataFrame]:
    """All tables of a namespace in the model's column order; an error names those that aren't there."""
    if gone := [t for t, ok in existing(spark, model, namespace).items() if not ok]:
        raise FileNotFoundError(f"not in {namespace}: {', '.join(gone)}")
    return {t.name: spark.table(f"{namespace}.{t.name}").select(*t.column_names) for t in model.tables}
