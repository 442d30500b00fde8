"""Scalar functions as Column expressions; none runs Python on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.model import ColumnSpec

#: Fixed value: the first day of generated data.
BASE_DATE = "2026-07-06"
#: Prefixes of business ids; any other name is its own prefix.
ID_PREFIXES = {
    "customer": "CUST", "product": "PROD", "store": "STORE", "order": "ORDER", "order_item": "ORDERITEM", "payment": "PAYMENT", "delivery": "DELIVERY",
    "supplier": "SUPPLIER", "employee": "EMPLOYEE", "user": "USER", "account": "ACCOUNT", "invoice": "INVOICE", "transaction": "TXN",
}
#: Fixed value: the name space of name-based UUIDs for DNS names (RFC 4122).
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def missing(c: Column) -> Column:
    """Null or the empty string, as validation sees it."""
    return c.isNull() | (c.cast("string") == "")


def placeholder(c: Column) -> Column:
    """Text like ``customer_name_001``."""
    return F.lower(c).rlike(r"^[a-z_]+_\d{3}$")


def semantic_placeholder(c: Column) -> Column:
    """Text like ``Record 001`` or ``Sales Item 0001`` in a column that should say something."""
    return F.trim(c).rlike(r"^[A-Z][A-Za-z_]*(?:\s+[A-Z][A-Za-z_]*)?\s+\d{3,6}$")


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def cyclic_date_key(index: Column, base: str = BASE_DATE) -> Column:
    """The date key of row ``index`` (from 1), again from the start after 365 days."""
    return date_key(F.date_add(F.to_date(F.lit(base)), F.pmod(index - 1, F.lit(365)).cast("int")))


def id_prefix(column: str) -> str:
    name = column.lower().removesuffix("_id") if column.lower().endswith("_id") else column.lower()
    return ID_PREFIXES.get(name) or "".join(c for c in name.upper() if c.isascii() and c.isalnum()) or "ID"


def business_id(column: str, index: Column) -> Column:
    """PREFIX-000001; orders carry their date key: ORDER-20260706-000001."""
    name, prefix = column.lower(), id_prefix(column)
    if name == "order_id" or name.endswith("_order_id"):
        return F.format_string(f"{prefix}-%d-%06d", cyclic_date_key(index), index)
    return F.format_string(f"{prefix}-%06d", index)


def text_key(table: str, index: Column) -> Column:
    """TABLE-000001, of at most twelve letters of the table's name without layer marks."""
    name = table.lower()
    for mark in ("dim_", "fact_", "stg_", "load_"):
        if name.startswith(mark):
            name = name[len(mark) :]
            break
    letters = "".join(c for c in name.replace("_raw", "") if c.isascii() and c.isalnum()).upper()[:12] or "ROW"
    return F.format_string(f"{letters}-%06d", index)


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cycle(values: list, index: Column) -> Column:
    """Row ``index`` takes the values in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index - 1, F.lit(len(values))) + 1).cast("int"))


def draw(low: int, high: int, seed: int, *parts: str | Column) -> Column:
    """A whole number low..high that depends on the parts alone, in whatever order rows are made."""
    mixed = F.xxhash64(F.lit(seed), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (F.pmod(mixed, F.lit(high - low + 1)) + F.lit(low)).cast("long")


def power_rank(size: int, exponent: float, *parts: str | int | Column) -> Column:
    """A rank 1..size that depends on the parts alone; rank k or less has the share that the density x**-exponent has up to k + 1, from 1 to size + 1."""
    u = (F.pmod(F.xxhash64(*(F.lit(p) if isinstance(p, (str, int)) else p for p in parts)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if exponent == 1:
        rank = F.exp(u * math.log(size + 1))
    else:
        rank = F.pow(u * ((size + 1.0) ** (1 - exponent) - 1) + 1, F.lit(1 / (1 - exponent)))
    return F.greatest(F.lit(1), F.least(F.lit(size), F.floor(rank).cast("long")))


def quantise(c: Column, scale: int) -> Column:
    """Rounded half to even, as decimal contexts do."""
    return F.bround(c, scale)


def bounded(c: Column, length: int | None) -> Column:
    return F.substring(c, 1, length) if length else c


def email(first: Column, last: Column, index: Column, length: int | None = None) -> Column:
    long = F.concat(F.regexp_replace(F.lower(F.concat_ws(".", first, last, F.format_string("%03d", index))), "[^a-z0-9.]", ""), F.lit("@example.com"))
    if length is None:
        return long
    return bounded(F.when(F.length(long) > length, F.format_string("u%d@x.co", index)).otherwise(long), length)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, 0 if end is earlier; null if either is."""
    minutes = F.timestamp_diff("MINUTE", start, end)
    return F.when(minutes.isNotNull(), F.greatest(F.lit(0).cast("long"), minutes))


def as_number(c: Column, kind: T.DataType | str) -> Column:
    """``try_cast`` to a number; a text that can't be one is told by its characters, for each cast that fails throws."""
    return F.when(c.cast("string").rlike(r"^[\s\x00-\x20]*[+-]?(\d|\.\d|(?i:inf|nan))"), c.try_cast(kind))


def coerce(c: Column, spec: ColumnSpec, index: Column | None = None) -> Column:
    """``c`` as the column's type; values that can't be one become the type's fallback, null stays null."""
    kind = spec.spark_type
    if spec.base in ("boolean", "bool"):
        said = F.lower(F.trim(c.cast("string")))
        return F.when(c.isNotNull(), said.isin("true", "yes", "1", "y"))
    if isinstance(kind, T.StringType):
        return bounded(c.cast("string"), spec.max_length)
    if isinstance(kind, T.DecimalType):
        value = F.bround(as_number(c, "decimal(38,10)"), kind.scale).try_cast(kind)
    elif spec.is_integer:
        value = as_number(c, "decimal(38,10)").try_cast(kind)
    else:
        value = c.try_cast(kind)
    return F.when(c.isNotNull(), F.coalesce(value, fallback(spec)))


def fallback(spec: ColumnSpec) -> Column:
    """The value of a type that stands in for one that can't be converted."""
    kind = spec.spark_type
    if spec.is_integer:
        by_date = spec.name.lower() == "date_key" or spec.name.lower().endswith("_date_key")
        return F.lit(int(BASE_DATE.replace("-", "")) if by_date else 1).cast(kind)
    if spec.is_numeric:
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(BASE_DATE).cast(kind)
    return F.lit({"boolean": "false", "bool": "false", "time": "12:00:00"}.get(spec.base, "")).cast(kind)


def safe_cell(c: Column, kind: T.DataType) -> Column:
    """A value as a spreadsheet cell: no zone, no decimal or nested types, no text that reads as a formula."""
    if isinstance(kind, T.TimestampType):
        return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    return c


def json_field(payload: Column, key: str, kind: str) -> Column:
    """``payload->>'key'`` as a type; null where it isn't there or isn't one."""
    return F.get_json_object(payload, f"$.{key}").try_cast(kind)


def is_json_object(payload: Column) -> Column:
    return F.coalesce(F.json_object_keys(payload).isNotNull() & F.ltrim(payload).startswith("{"), F.lit(False))


def check_holds(c: Column, op: str, values: tuple[str, ...]) -> Column:
    """Whether a value satisfies a CHECK; missing and non-numeric values do."""
    if op == "IN":
        holds = c.cast("string").isin(*values)
    else:
        n = c.try_cast("decimal(38,10)")
        low = F.lit(values[0]).cast("decimal(38,10)")
        holds = {
            "BETWEEN": lambda: n.between(low, F.lit(values[-1]).cast("decimal(38,10)")),
            ">": lambda: n > low, ">=": lambda: n >= low, "<": lambda: n < low, "<=": lambda: n <= low,
        }[op]()
    return missing(c) | F.coalesce(holds, F.lit(True))
