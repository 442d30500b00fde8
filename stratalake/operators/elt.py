"""Raw envelopes, typed staging, dimensions with surrogate keys, facts, calendars."""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import date_key
from stratalake.model import TableSpec
from stratalake.scratch import written


def to_raw(rows: DataFrame, source: str, *order: str, payload: str = "source_payload") -> DataFrame:
    """One JSON object a row in an envelope with load data; nulls stay in the object."""
    body = F.to_json(F.struct(*(F.col(c) for c in rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(*order, body.alias(payload), F.lit(source).alias("source_system"))


def to_staging(raw: DataFrame, schema: T.StructType | str, payload: str = "source_payload") -> DataFrame:
    """The typed columns of each payload: one parse a row for all columns."""
    return raw.select(F.from_json(payload, schema).alias("p")).select("p.*")


def number_rows(rows: DataFrame, name: str, *keys: str, after: int = 0) -> DataFrame:
    """``rows`` with numbers ``after`` + 1, 2, ... in order of ``keys`` (nulls last), which should be unique in ``rows``.

    Written once in ranges of the keys, a sorted file a range.  A row's number is
    its place in the file after the rows of the files before it, so no task sees
    more than a range and reading needs neither a shuffle nor a sort.
    """
    order = [F.asc_nulls_last(k) for k in keys]
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order), "numbered")
    file, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    # One row a file: as many as ranges, whatever the number of rows.
    sizes = {r["file"]: r["n"] for r in held.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
    files = sorted(sizes, key=lambda f: int(f.split("-")[1]))  # part-<number>-..., of five digits or more
    if len(files) <= 1:
        return held.withColumn(name, place + 1 + after)
    starts = list(zip(files, itertools.accumulate((sizes[f] for f in files[:-1]), initial=after), strict=True))
    of, start = own_column(rows, "file_of_row"), own_column(rows, "rows_before")
    before = rows.sparkSession.createDataFrame(starts, f"{of} string, {start} long")
    return held.select("*", place.alias(name), file.alias(of)).join(before, of).withColumn(name, F.col(name) + F.col(start) + 1).drop(of, start)


def known_keys(rows: DataFrame, table: TableSpec, number: str, key: tuple[str, ...], saved) -> DataFrame:
    """(key, number) of the business keys of ``rows`` that ``table`` has saved; null equals null.  ``saved``: see ``sources.ledger.Saved``."""
    mine = written(rows.select(*key).distinct(), "keys")
    there = saved.matching(table.name, key, mine, number).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), number)
    return mine.join(there, [mine[c].eqNullSafe(there[f"_k{i}"]) for i, c in enumerate(key)]).select(*key, number)


def number_new(rows: DataFrame, table: TableSpec, number: str, order: str, saved) -> DataFrame:
    """``rows`` that ``table`` hasn't saved yet, numbered on from its highest number.

    A row is saved if its business key is: the first UNIQUE set whose columns ``rows``
    has.  It keeps its number and isn't written again.  Without such a set all rows are new.
    """
    if saved is None or saved.table(table.name) is None:
        return number_rows(rows, number, order)
    given = {c.lower(): c for c in rows.columns}
    key = next((u.columns for u in table.uniques if all(c.lower() in given for c in u.columns)), None)
    if key:
        rows = rows.withColumnsRenamed({given[c.lower()]: c for c in key})
        known = known_keys(rows, table, number, key, saved).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)))
        rows = rows.join(known, [rows[c].eqNullSafe(known[f"_k{i}"]) for i, c in enumerate(key)], "left_anti")
    return number_rows(rows, number, order, after=saved.last(table.name, number))


def own_column(df: DataFrame, name: str) -> str:
    """``name``, or a longer form that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their scan has fewer tasks than that; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dimension(source: DataFrame, key: str, business_key: str, *attributes: str) -> DataFrame:
    """One row a business key with a surrogate key in its order; of rows that repeat a key the smallest by attributes counts."""
    least = source.groupBy(business_key).agg(F.min(F.struct(*attributes)).alias("row"))
    return number_rows(least.select(business_key, "row.*"), key, business_key).select(key, business_key, *attributes)


def calendar(*dates: DataFrame) -> DataFrame:
    """Every day from the first to the last date of some one-column tables, with its attributes; the two bounds are read at once."""
    spans = [d.select(F.min(d.columns[0]).cast("date").alias("a"), F.max(d.columns[0]).cast("date").alias("b")) for d in dates]
    a, b = reduce(DataFrame.unionAll, spans).agg(F.min("a"), F.max("b")).first()
    days = dates[0].sparkSession.range((b - a).days + 1 if a else 0).coalesce(1)
    return calendar_columns(days.select(F.date_add(F.lit(a).cast("date"), F.col("id").cast("int")).alias("full_date")))


def calendar_columns(days: DataFrame, day: str = "full_date") -> DataFrame:
    d = F.col(day)
    iso = F.weekday(d) + 1
    return days.select(
        date_key(d).alias("date_key"), d.alias("full_date"), iso.cast("long").alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).cast("long").alias("week_of_year"), F.month(d).cast("long").alias("month_number"), F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("long").alias("quarter_number"), F.year(d).cast("long").alias("year_number"), iso.isin(6, 7).alias("is_weekend"),
    )


def look_up(fact: DataFrame, dim: DataFrame, on: Column | str, key: str, role: str | None = None, how: str = "inner") -> DataFrame:
    """``fact`` with the surrogate key of a dimension, named ``role`` where it plays several.

    Only the join columns and the key of ``dim`` take part; Spark broadcasts it if it is small.
    """
    if isinstance(on, str):
        side = dim.select(F.col(on).alias("_on"), F.col(key).alias(role or key))
        return fact.join(side, fact[on] == side["_on"], how).drop("_on")
    raise TypeError("name a column that both sides have")


def look_up_date(fact: DataFrame, dates: DataFrame, column: str, role: str, how: str = "inner") -> DataFrame:
    """The date key of ``column`` under the name ``role``; ``how='left'`` keeps rows without a date."""
    side = dates.select(F.col("full_date").alias("_day"), F.col("date_key").alias(role))
    return fact.join(side, F.to_date(fact[column]) == side["_day"], how).drop("_day")


def fit_to_table(rows: DataFrame, table: TableSpec, order: str | None = None, saved=None) -> DataFrame:
    """Columns of ``table`` in its order: casts, literal defaults, numbers for an integer key that isn't given.

    A column that the table lacks is an error, as is a missing required column.  With
    ``saved`` the rows are to be added: numbers go on, see ``number_new``.
    """
    if strange := [c for c in rows.columns if not table.has(c)]:
        raise ValueError(f"{table.full_name} has no column {strange[0]}")
    given = {c.lower(): c for c in rows.columns}
    out, numbered = [], None
    for c in table.columns:
        value = F.col(given[c.name.lower()]) if c.name.lower() in given else None
        default = default_value(c.default) if c.default is not None else None
        if value is None and default is None and c.is_integer and c.name in table.primary_key:
            numbered = c.name
            value = F.col(c.name)
        elif value is None and default is None and not c.nullable:
            raise ValueError(f"{table.full_name}.{c.name} is required and not given")
        elif value is None:
            value = default if default is not None else F.lit(None)
        out.append(value.cast(c.spark_type).alias(c.name))
    if numbered is not None:
        rows = number_new(rows, table, numbered, order or rows.columns[0], saved)
    return rows.select(*out)


def default_value(text: str) -> Column | None:
    """A DEFAULT as an expression: literals, the current time or date; others give null."""
    said = text.split("::")[0].strip()
    low = said.lower()
    if low in ("now()", "current_timestamp", "current_timestamp()", "localtimestamp"):
        return F.current_timestamp()
    if low in ("current_date", "current_date()"):
        return F.current_date()
    if low in ("true", "false"):
        return F.lit(low == "true")
    if said.startswith("'") and said.endswith("'"):
        return F.lit(said[1:-1].replace("''", "'"))
    try:
        return F.lit(float(said) if "." in said else int(said))
    except ValueError:
        return None


def from_rows(spark: SparkSession, table: TableSpec, rows: list[dict]) -> DataFrame:
    """A small list of rows, of which each may give other columns, as the table's frame.

    A column that a row leaves out gets its default there, an integer key the next
    number; a null that is given stays.  A required column that a row leaves out
    without a default is an error.
    """
    if strange := [k for r in rows for k in r if not table.has(k)]:
        raise ValueError(f"{table.full_name} has no column {strange[0]}")
    kept = []
    for c in table.columns:
        given = [c.name in r for r in rows]
        default = default_value(c.default) if c.default is not None else None
        numbered = default is None and c.is_integer and c.name in table.primary_key
        if rows and not all(given) and default is None and not numbered and not c.nullable:
            raise ValueError(f"{table.full_name}.{c.name} is required and not given")
        numbers = itertools.count(1)
        values = [_text(r[c.name]) if g else str(next(numbers)) if numbered else None for r, g in zip(rows, given, strict=True)]
        kept.append((c, default, [g or numbered for g in given], values))
    schema = T.StructType([T.StructField(f"{x}{k}", t) for k in range(len(kept)) for x, t in (("v", T.StringType()), ("g", T.BooleanType()))])
    flat = [[x for _, _, g, v in kept for x in (v[k], g[k])] for k in range(len(rows))]
    frame = spark.createDataFrame(flat, schema)
    cells = []
    for k, (c, default, _, _) in enumerate(kept):
        value = F.col(f"v{k}").cast(c.spark_type)
        left_out = default.cast(c.spark_type) if default is not None else F.lit(None).cast(c.spark_type)
        cells.append(F.when(F.col(f"g{k}"), value).otherwise(left_out).alias(c.name))
    return frame.select(*cells)


def _text(value) -> str | None:
    """A cell as text that a cast can read."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def positional_parent(children: DataFrame, parents: DataFrame, parent_rows: int, index: str = "idx", parent_index: str = "idx", columns: dict[str, str] | None = None) -> DataFrame:
    """Child row i takes columns of parent row (i - 1) mod n + 1; ``columns``: parent column -> child column."""
    side = parents.select(F.col(parent_index).alias("_at"), *(F.col(p).alias(c) for p, c in (columns or {}).items()))
    return children.withColumn("_of", F.pmod(F.col(index) - 1, F.lit(parent_rows)) + 1).join(side, F.col("_of") == F.col("_at")).drop("_of", "_at")
