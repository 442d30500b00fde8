"""Validation of loaded tables as DataFrames of check results.

All row-level checks of a table are counted in one pass (one two-phase
aggregate over the columns that have checks); each key takes one grouping and
each foreign key one anti join against the parent's distinct keys.  A result is
one row a check: (check_id, table_name, columns, severity, violations, sample).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import as_number, check_holds, is_json_object, missing, placeholder, semantic_placeholder
from stratalake.model import ColumnSpec, ForeignKey, TableSpec, WarehouseModel
from stratalake.plans.layers import DIMENSION, FACT, RAW, STAGING, Plan
from stratalake.plans.profile import Profile
from stratalake.plans.semantics import Meaning
from stratalake.scratch import written

ERROR, WARNING, INFO = "error", "warning", "info"
RESULT = "check_id string, table_name string, columns string, severity string, violations long, sample string"
#: Meanings and name parts of columns whose text should say something.
DESCRIPTIVE = {
    "person_name", "company_name", "organization_name", "product_name", "service_name", "product_or_service", "date", "birth_date", "timestamp", "country",
    "nationality", "city", "region", "status", "category", "type", "method", "role", "position", "amount", "price", "quantity", "count", "score", "rank",
    "percentage", "boolean", "description",
}
DESCRIPTIVE_NAMES = ["name", "date", "status", "category", "type", "method", "country", "city", "role", "position", "amount", "price", "quantity", "count", "description"]
IDENTIFIERS = {"identifier", "business_key", "surrogate_key", "foreign_key", "date_key"}

Data = dict[str, DataFrame]


def row(check_id: str, table: str, columns: str, severity: str, violations: Column, sample: Column | None = None) -> Column:
    return F.struct(
        F.lit(check_id).alias("check_id"), F.lit(table).alias("table_name"), F.lit(columns).alias("columns"), F.lit(severity).alias("severity"),
        F.coalesce(violations, F.lit(0)).cast("long").alias("violations"), (sample if sample is not None else F.lit(None)).cast("string").alias("sample"),
    )


def results(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)


def type_violation(c: Column, spec: ColumnSpec) -> Column:
    """A value that is there but can't be read as the column's type."""
    if spec.base in ("boolean", "bool"):
        bad = ~F.lower(F.trim(c.cast("string"))).isin("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0")
    elif spec.is_json:
        bad = F.lit(False)  # any text can be written as JSON
    elif spec.base == "time":
        bad = ~c.cast("string").rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")
    elif isinstance(spec.spark_type, T.StringType):
        bad = F.lit(False)
    elif spec.is_numeric:
        bad = as_number(c, "double").isNull()  # too many digits are another check's matter
    elif spec.is_integer:
        bad = as_number(c, spec.spark_type).isNull()
    else:
        bad = c.try_cast(spec.spark_type).isNull()
    return ~missing(c) & F.coalesce(bad, F.lit(False))


def digits_violation(c: Column, precision: int, scale: int) -> Column:
    """A number with too many digits before or after the point."""
    n = as_number(c, "decimal(38,10)")
    return n.isNotNull() & ((F.abs(n) >= F.lit(10 ** (precision - scale))) | (n != F.round(n, scale)))


def row_checks(table: TableSpec, df: DataFrame, meanings: dict[tuple[str, str], Meaning] | None = None, expected: int | None = None, at_least: bool = False, kinds: set[str] | None = None) -> DataFrame:
    """Counts of V1 to V6, V9 and V12, or of some ``kinds`` of them, in one pass.

    The sample is the violation in the row with the smallest primary key (``key: value``), or the smallest value where no key is there.
    """
    found: list[tuple[str, str, str, Column]] = []  # check, columns, severity, predicate
    present = {c.lower(): c for c in df.columns}
    types = {f.name: f.dataType for f in df.schema}
    for spec in table.columns:
        if spec.name.lower() not in present:
            continue
        name = present[spec.name.lower()]
        c, text = F.col(name), isinstance(types[name], T.StringType)
        if not spec.nullable:
            found.append(("required", name, ERROR, missing(c)))
        if spec.max_length and text:
            found.append(("length", name, ERROR, F.length(c) > spec.max_length))
        if text and not isinstance(spec.spark_type, T.StringType) or spec.base == "time" and text:
            found.append(("type", name, ERROR, type_violation(c, spec)))
        if spec.precision is not None:
            found.append(("digits", name, ERROR, digits_violation(c, spec.precision, spec.scale or 0)))
        if text:
            found.append(("placeholder", name, WARNING, placeholder(c)))
            kind = meanings[(table.name, spec.name)].kind if meanings else ""
            if kind not in IDENTIFIERS and (kind in DESCRIPTIVE or any(w in name.lower() for w in DESCRIPTIVE_NAMES)):
                found.append(("semantic_placeholder", name, ERROR, semantic_placeholder(c)))
    for check in table.checks:
        if check.supported and check.column and check.column.lower() in present:
            found.append(("check", check.column, ERROR, ~check_holds(F.col(present[check.column.lower()]), check.op, check.values)))
    found = [x for x in found if kinds is None or x[0] in kinds]
    keys = [present[k.lower()] for k in table.primary_key if k.lower() in present]

    def first(columns: str, p: Column) -> Column:
        shown = F.coalesce(F.col(present[columns.lower()]).cast("string"), F.lit("null"))
        return F.min(F.when(p, F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), shown.alias("shown"))))

    counts = [x for k, (_, columns, _, p) in enumerate(found) for x in (F.count_if(p).alias(f"v{k}"), first(columns, p).alias(f"s{k}"))]
    total = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    said = lambda k: F.concat(F.concat_ws(", ", *(F.coalesce(F.col(f"s{k}.k{i}").cast("string"), F.lit("null")) for i in range(len(keys)))), F.lit(": " if keys else ""), F.col(f"s{k}.shown"))
    rows = [row(check, table.name, columns, severity, F.col(f"v{k}"), said(k)) for k, (check, columns, severity, _) in enumerate(found)]
    if expected is not None:
        bad = F.col("_rows") < expected if at_least else F.col("_rows") != expected
        rows.insert(0, row("row_count", table.name, "*", ERROR, bad.cast("long"), F.format_string(f"{expected} expected, %d found", "_rows")))
    return results(total, *rows) if rows else df.sparkSession.createDataFrame([], RESULT)


def duplicate_keys(df: DataFrame, *columns: str, nulls_distinct: bool = False) -> DataFrame:
    """(columns..., n) of keys that occur more than once; nulls are equal unless ``nulls_distinct``."""
    if nulls_distinct:
        df = df.dropna(how="any", subset=list(columns))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_check(check_id: str, table: str, df: DataFrame, columns: tuple[str, ...], nulls_distinct: bool = False, saved=None) -> DataFrame:
    """How many keys occur more than once, and the smallest of them.

    With ``saved`` (``sources.ledger.Saved``) ``df`` is to be added to rows that were
    saved before: a key that one of those has counts too.
    """
    text = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    if saved is None or saved.table(table) is None:
        found = duplicate_keys(df, *columns, nulls_distinct=nulls_distinct)
    else:
        mine = written((df.dropna(how="any", subset=list(columns)) if nulls_distinct else df).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "keys")
        there = saved.matching(table, columns, mine.select(*columns)).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)))
        again = mine.join(there, [mine[c].eqNullSafe(there[f"_k{i}"]) for i, c in enumerate(columns)], "left_semi")
        found = mine.filter("n > 1").unionByName(again).distinct()
    return results(found.agg(F.count(F.lit(1)).alias("v"), F.min(text).alias("s")), row(check_id, table, ", ".join(columns), ERROR, F.col("v"), F.col("s")))


def orphans(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...], empty_is_missing: bool = True) -> DataFrame:
    """Child rows whose key is whole and has no parent."""
    gone = [missing(F.col(c)) if empty_is_missing else F.col(c).isNull() for c in columns]
    whole = child.filter(~reduce(lambda a, b: a | b, gone))
    keys = parent.select(*(F.col(p).alias(f"_p{k}") for k, p in enumerate(parent_columns)))
    return whole.join(keys, [whole[c] == keys[f"_p{k}"] for k, c in enumerate(columns)], "left_anti")


def fk_check(table: str, child: DataFrame, fk: ForeignKey, parent: DataFrame, check_id: str = "foreign_key", saved=None) -> DataFrame:
    """Child rows without a parent; with ``saved`` the parent's rows that were saved before count as parents too."""
    found = orphans(child, fk.columns, parent, fk.parent_columns)
    if saved is not None and saved.table(fk.parent) is not None:
        left = written(found.groupBy(*fk.columns).agg(F.count(F.lit(1)).alias("_n")), "orphans")
        there = saved.matching(fk.parent, fk.parent_columns, left.select(*(F.col(c).alias(p) for c, p in zip(fk.columns, fk.parent_columns, strict=True))))
        there = there.select(*(F.col(p).alias(f"_p{k}") for k, p in enumerate(fk.parent_columns)))
        found = left.join(there, [left[c] == there[f"_p{k}"] for k, c in enumerate(fk.columns)], "left_anti")
    else:
        found = found.withColumn("_n", F.lit(1))
    text = F.concat_ws(", ", *(F.col(c).cast("string") for c in fk.columns))
    said = f"{', '.join(fk.columns)} -> {fk.parent}({', '.join(fk.parent_columns)})"
    return results(found.agg(F.sum("_n").alias("v"), F.min(text).alias("s")), row(check_id, table, said, ERROR, F.col("v"), F.col("s")))


def undeclared_keys(model: WarehouseModel) -> list[tuple[str, str]]:
    """Columns that look like a foreign key and aren't one."""
    return [
        (t.name, c.name) for t in model.tables for c in t.columns
        if c.name.lower().endswith(("_id", "_key")) and c.name not in t.primary_key and not any(c.name in fk.columns for fk in t.foreign_keys)
    ]


def validate(model: WarehouseModel, data: Data, expected: dict[str, int] | None = None, meanings: dict | None = None, at_least: bool = False, saved=None) -> DataFrame:
    """V1 to V12 over all tables of a model; a table that isn't in ``data`` has no rows.

    With ``saved`` (``sources.ledger.Saved``) ``data`` are rows to be added: keys and
    foreign keys are checked against what was saved before as well.
    """
    spark = next(iter(data.values())).sparkSession
    frames = {t.name: data[t.name] if t.name in data else spark.createDataFrame([], t.struct) for t in model.tables}
    parts = []
    for t in model.tables:
        df = frames[t.name]
        parts.append(row_checks(t, df, meanings, (expected or {}).get(t.name), at_least))
        if t.primary_key:
            parts.append(key_check("primary_key", t.name, df, t.primary_key, saved=saved))
        parts += [key_check("unique", t.name, df, u.columns, saved=saved) for u in t.uniques]
        parts += [fk_check(t.name, df, fk, frames[model.table(fk.parent).name], saved=saved) for fk in t.foreign_keys]
    loose = undeclared_keys(model)
    if loose:
        parts.append(spark.createDataFrame([("undeclared_key", t, c, WARNING, 1, None) for t, c in loose], RESULT))
    return union(parts, spark)


def status(checks: DataFrame) -> DataFrame:
    """One row: failed if an error has violations, passed_with_warnings if a warning has, else passed."""
    hit = checks.filter("violations > 0").agg(F.count_if(F.col("severity") == ERROR).alias("e"), F.count_if(F.col("severity") == WARNING).alias("w"))
    return hit.select(F.when(F.col("e") > 0, "failed").when(F.col("w") > 0, "passed_with_warnings").otherwise("passed").alias("status"), F.col("e").alias("errors"), F.col("w").alias("warnings"))


# Lineage


def not_contained(child: DataFrame, column: str, parents: list[DataFrame], parent_column: str | None = None) -> DataFrame:
    """Distinct values of a column that no parent has; missing values don't count."""
    mine = child.select(F.col(column).alias("v")).filter(~missing(F.col("v"))).distinct()
    theirs = reduce(DataFrame.unionAll, [p.select(F.col(parent_column or column).cast(child.schema[column].dataType).alias("v")) for p in parents]).distinct()
    return mine.join(theirs, "v", "left_anti")


def lineage_keys(t: TableSpec) -> list[str]:
    """Business keys for lineage checks: not in the primary key."""
    return [c.name for c in t.columns if c.name not in t.primary_key and c.name.lower().endswith(("_id", "_code", "_number", "_no"))]


def validate_lineage(model: WarehouseModel, data: Data, plan: Plan, payload: str | None = "source_payload", parents: Data | None = None, saved=None) -> DataFrame:
    """V13 to V15.  A key that a raw table keeps in its payload is read from there.

    ``parents``: the tables that rows may come from, if those aren't the same, as when
    ``data`` are rows to be added to ``saved`` ones.
    """
    parents_of = parents or data
    spark = next(iter(data.values())).sparkSession
    parts, notes = [], []

    def source(name: str, column: str) -> DataFrame | None:
        t = model.table(name)
        if t.has(column):
            return parents_of[name].select(column)
        if payload and t.has(payload):
            return parents_of[name].select(F.get_json_object(payload, f"$.{column}").alias(column))
        return None

    for role, below, check_id in ((STAGING, RAW, "staging_in_raw"), (DIMENSION, STAGING, "dimension_in_staging")):
        for name in plan.of(role):
            sources = plan.sources(name, below)
            keys = lineage_keys(model.table(name))
            if role == STAGING and not keys:
                keys = [c.name for c in model.table(name).columns if any(model.table(s).has(c.name) for s in sources)]
            compared = 0
            for key in dict.fromkeys(keys):
                parents = [p for s in sources if s in parents_of and (p := source(s, key)) is not None]
                if parents and name in data:
                    gone = not_contained(data[name], key, parents).agg(F.count(F.lit(1)).alias("v"), F.min(F.col("v").cast("string")).alias("s"))
                    parts.append(results(gone, row(check_id, name, f"{key} in {', '.join(sources)}", ERROR, F.col("v"), F.col("s"))))
                    compared += 1
            if not compared:
                notes.append((check_id, name, "nothing to compare" if sources else "no source"))
    for name in plan.of(FACT):
        declared = [fk for fk in model.table(name).foreign_keys if plan.roles.get(fk.parent) == DIMENSION]
        parts += [fk_check(name, data[name], fk, data[fk.parent], "fact_in_dimension", saved) for fk in declared if name in data and fk.parent in data]
        if not declared:
            notes.append(("fact_in_dimension", name, "no foreign key to a dimension"))
    if notes:  # lineage notes don't change the status
        parts.append(spark.createDataFrame([(c, t, note, INFO, 1, None) for c, t, note in notes], RESULT))
    return union(parts, spark)


# Realism


def temporal_span(data: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(first_day, last_day, span_days, distinct_days, n_dates) over the named date columns of all tables."""
    parts = [df.select(F.explode(F.array(*(F.col(c).cast("date") for c in columns))).alias("d")) for df, columns in data.values() if columns]
    days = reduce(DataFrame.unionAll, parts).filter("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return days.agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.datediff(F.max("d"), F.min("d")).cast("long").alias("span_days"),
        F.count(F.lit(1)).alias("distinct_days"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_dates"),
    )


def reuse(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """One row: child_rows, skipped (missing keys), unresolved, parents_used, parents_reused, parent_rows, artificial (more children than parents, none reused)."""
    gone = reduce(lambda a, b: a | b, (missing(F.col(c)) for c in columns))
    sizes = child.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("_gone", gone)
    keys = parent.select(*(F.col(p).alias(f"_p{k}") for k, p in enumerate(parent_columns)), F.lit(True).alias("_known")).distinct()
    joined = sizes.join(keys, [sizes[c] == keys[f"_p{k}"] for k, c in enumerate(columns)], "left")
    whole = ~F.col("_gone")
    stats = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"), F.coalesce(F.sum(F.when(F.col("_gone"), F.col("n"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.when(whole & F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("unresolved"),
        F.count_if(whole).alias("parents_used"), F.count_if(whole & (F.col("n") > 1)).alias("parents_reused"),
    )
    total = parent.agg(F.count(F.lit(1)).alias("parent_rows"))
    both = stats.join(total, F.lit(True))  # one row with one row
    artificial = (F.col("unresolved") == 0) & (F.col("child_rows") - F.col("skipped") > F.col("parent_rows")) & (F.col("parents_reused") == 0)
    return both.withColumn("artificial", artificial)


def row_counts(data: Data) -> DataFrame:
    """(table_name, row_count) of all tables, in one job."""
    return reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in data.items()])


def uniform_counts(counts: DataFrame) -> DataFrame:
    """One row: non_empty tables, distinct counts, uniform (four or more tables, all with one count above 1)."""
    some = counts.filter("row_count > 0").agg(F.count(F.lit(1)).alias("non_empty"), F.count_distinct("row_count").alias("distinct_counts"), F.max("row_count").alias("_n"))
    return some.select("non_empty", "distinct_counts", F.coalesce((F.col("non_empty") >= 4) & (F.col("distinct_counts") == 1) & (F.col("_n") > 1), F.lit(False)).alias("uniform"))


def validate_realism(model: WarehouseModel, data: Data, profile: Profile | None = None, parents: Data | None = None) -> DataFrame:
    """V16 to V19 as check rows; ``parents`` as in ``validate_lineage``."""
    spark = next(iter(data.values())).sparkSession
    least = min(profile.date_span_days, 30) if profile else 7
    timed = {
        t.name: (data[t.name], [f.name for f in data[t.name].schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))])
        for t in model.tables if t.name in data
    }
    parts = []
    if any(columns for _, columns in timed.values()):
        short = (F.col("n_dates") >= 10) & (F.col("span_days") < least)
        parts.append(results(temporal_span(timed), row("temporal_span", "*", f"at least {least} days", WARNING, short.cast("long"), F.col("span_days"))))
    for t in model.tables:
        for fk in t.foreign_keys:
            if t.name in data and (p := model.find(fk.parent)) is not None and p.name in data:
                said = f"{', '.join(fk.columns)} -> {p.name}"
                stats = reuse(data[t.name], fk.columns, (parents or data)[p.name], fk.parent_columns)
                parts.append(results(
                    stats, row("reference", t.name, said, ERROR, F.col("unresolved"), F.format_string("%d rows, %d parents, %d reused", "child_rows", "parents_used", "parents_reused")),
                    row("reuse", t.name, said, WARNING, F.col("artificial").cast("long")),
                ))
    parts.append(results(uniform_counts(row_counts(data)), row("uniform_counts", "*", "row counts", WARNING, F.col("uniform").cast("long"))))
    return union(parts, spark)


# Raw payloads


def payload_checks(name: str, raw: DataFrame, required: list[str], payload: str = "source_payload") -> DataFrame:
    """V24: payloads are JSON objects, and each required key is in each object."""
    keys = F.json_object_keys(payload)
    objects = raw.select(is_json_object(F.col(payload)).alias("ok"), F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
    counts = objects.agg(F.count_if(~F.col("ok")).alias("o"), *(F.count_if(F.col("ok") & ~F.array_contains("keys", k)).alias(f"k{i}") for i, k in enumerate(required)))
    return results(counts, row("payload_object", name, payload, ERROR, F.col("o")), *(row("payload_key", name, k, ERROR, F.col(f"k{i}")) for i, k in enumerate(required)))


def payload_keys(raw: DataFrame, key: str, payload: str = "source_payload") -> DataFrame:
    """One row: records, distinct values of a key in their payloads (null is a value), and values that several records share."""
    sizes = raw.select(F.get_json_object(payload, f"$.{key}").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("reused_keys"))


def payload_references(profile: Profile, data: Data, payload: str = "source_payload") -> DataFrame:
    """V25: keys in child payloads are in parent payloads (null is a value here), and parents are reused where they must be."""
    spark = next(iter(data.values())).sparkSession
    parts = []
    for r in profile.relationships:
        def keys(table: str, columns: tuple[str, ...]) -> DataFrame:
            return data[table].select(*(F.get_json_object(payload, f"$.{c}").alias(f"k{i}") for i, c in enumerate(columns)))

        child, parent = keys(r.child_raw, r.child_columns), keys(r.parent_raw, r.parent_columns).distinct().withColumn("_known", F.lit(True))
        sizes = child.groupBy(*child.columns).agg(F.count(F.lit(1)).alias("n"))
        on = reduce(lambda a, b: a & b, (sizes[c].eqNullSafe(parent[c]) for c in child.columns))
        stats = sizes.join(parent, on, "left").agg(F.sum(F.when(F.col("_known").isNull(), F.col("n"))).alias("v"), F.max("n").alias("most"))
        said = f"{', '.join(r.child_columns)} -> {r.parent_raw}"
        rows = [row("payload_reference", r.child_raw, said, ERROR, F.col("v"))]
        if r.require_reuse:
            rows.append(row("payload_reuse", r.child_raw, said, ERROR, (F.coalesce(F.col("most"), F.lit(0)) < 2).cast("long")))
        parts.append(results(stats, *rows))
    return union(parts, spark)
