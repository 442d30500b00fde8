"""Deterministic test data for a model: one select of column expressions a table.

A cell depends on (seed, entity, column, row number) alone, so any number of
tasks make the same rows, and tables about the same entity (a staging table
and its dimension, say) agree on shared columns without looking each other up.

Values by priority: foreign keys copy the parent's key (row i takes parent row
(i - 1) mod n); CHECKed columns take allowed values; the rest follow type, then
meaning.  Where a foreign key takes part in a key, parents are picked by mixed
radix digits of the row number, which makes the tuples distinct up to the
product of the parents' sizes; keys that share foreign keys: see ``_parent_numbers``.
Beyond their room, and where a list of allowed values is too short for a UNIQUE,
generation fails before it makes a row.  With ``reuse`` parents outside keys are taken
unevenly, by a power law.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions import columns as fn
from stratalake.functions.columns import BASE_DATE
from stratalake.model import Check, ColumnSpec, ForeignKey, TableSpec, WarehouseModel, words
from stratalake.plans.layers import RAW, STAGING, Plan, plan_layers
from stratalake.plans.profile import build_profile, capacity, payload_columns
from stratalake.plans.semantics import Meaning, meanings, reference_list


class CapacityError(ValueError):
    """Constraints leave less room than rows are asked for."""


#: Lists that cells take in turn.
STATUSES = ["New", "Active", "Pending", "Completed", "Inactive"]
SEGMENTS = ["New", "Regular", "Premium"]
METHODS = ["Online", "In Person", "Phone", "Partner"]
TYPES = ["Standard", "Preferred", "Specialty"]
ROLES = ["Lead", "Associate", "Specialist", "Coordinator", "Manager"]
# Our own vocabulary for names and places.
FIRST = ["Ada", "Bruno", "Chen", "Dina", "Elif", "Farid", "Greta", "Hugo", "Imani", "Jonas", "Kira", "Luca", "Mina", "Nils", "Oda", "Pavel"]
LAST = ["Adler", "Brandt", "Costa", "Dupont", "Egede", "Fischer", "Garcia", "Haddad", "Ito", "Jensen", "Kowalski", "Lindt", "Moreau", "Novak", "Okafor", "Petrov"]
CITIES = ["Aarhus", "Bergen", "Coimbra", "Dresden", "Espoo", "Ghent", "Haarlem", "Innsbruck", "Kaunas", "Leiden", "Malmo", "Nantes"]
COUNTRIES = ["Austria", "Belgium", "Canada", "Denmark", "Estonia", "Finland", "Ghana", "Hungary", "India", "Japan"]
NOUNS = ["Harbor", "Meadow", "Summit", "River", "Lantern", "Orchard", "Canyon", "Beacon", "Willow", "Ember"]


def entity_key(table: str) -> str:
    """What tables share values over: the last word of the name without layer marks."""
    name = table.lower().replace("_raw", "")
    for mark in ("load_", "stg_", "dim_", "fact_"):
        name = name.removeprefix(mark)
    return (words(name) or [name])[-1]


class _Cells:
    """Expressions for the cells of one table."""

    def __init__(self, table: TableSpec, seed: int, known: dict[tuple[str, str], Meaning], business: dict | None):
        self.t, self.seed, self.known, self.business = table, seed, known, business
        self.entity, self.i = entity_key(table.name), F.col("_row")
        self.title = " ".join(w.title() for w in words(table.name) if w not in ("dim", "fact", "stg", "load", "raw")) or "Item"

    def draw(self, column: str, low: int, high: int) -> Column:
        return fn.draw(low, high, self.seed, self.entity, column.lower(), self.i)

    def pick(self, column: str, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.draw(column, 1, len(values))).cast("int"))

    def key(self, c: ColumnSpec) -> Column:
        """A value that is another for each row."""
        name = c.name.lower()
        if c.base == "uuid":
            return fn.uuid5(F.concat(F.lit(f"{self.t.name}.{c.name}."), self.i.cast("string")))
        if c.is_integer:
            return fn.cyclic_date_key(self.i) if name == "date_key" or name.endswith("_date_key") else self.i
        if isinstance(c.spark_type, T.StringType):
            return fn.business_id(c.name, self.i) if name.endswith("_id") else fn.text_key(self.t.name, self.i)
        if isinstance(c.spark_type, T.DateType):
            return F.date_add(F.to_date(F.lit(BASE_DATE)), (self.i - 1).cast("int"))
        if isinstance(c.spark_type, (T.TimestampType, T.TimestampNTZType)):
            return F.timestamp_add("MINUTE", self.i - 1, F.lit(BASE_DATE).cast(c.spark_type))
        return self.i

    def checked(self, c: ColumnSpec) -> Column | None:
        """A value that the column's CHECK allows: lists in turn, ranges from their low end upward."""
        for check in self.checks(c):
            if check.op == "IN":
                return fn.cycle(list(check.values), self.i)
            return self.in_range(c, check)
        return None

    def checks(self, c: ColumnSpec) -> list[Check]:
        return [k for k in self.t.checks if k.supported and (k.column or "").lower() == c.name.lower()]

    def in_range(self, c: ColumnSpec, check: Check) -> Column:
        low = F.lit(check.values[0]).cast("decimal(38,10)")
        if check.op == "BETWEEN":
            span = F.floor(F.lit(check.values[-1]).cast("decimal(38,10)") - low)
            return low + F.pmod(self.i - 1, span.cast("long") + 1)
        room = F.pmod(self.i - 1, F.lit(25))
        step = {">": room + 1, ">=": room, "<": -room - 1, "<=": -room}[check.op]
        return low + step

    def value(self, c: ColumnSpec) -> Column:
        """By type, then meaning, then name."""
        name, kind, typ = c.name.lower(), self.known[(self.t.name, c.name)].kind, c.spark_type
        parts = set(words(name))
        if isinstance(typ, T.BooleanType):
            return self.i % 2 == 0
        if isinstance(typ, T.DateType):
            if kind == "birth_date" or "birth" in name:
                return F.make_date((F.lit(1970) + self.i % 35).cast("int"), (F.pmod(self.i - 1, F.lit(12)) + 1).cast("int"), (F.pmod(self.i - 1, F.lit(28)) + 1).cast("int"))
            return F.date_sub(F.to_date(F.lit(BASE_DATE)), self.draw(name, 0, 730).cast("int"))
        if c.base == "time":
            return F.format_string("%02d:%02d:00", self.i % 23, self.i % 59)
        if isinstance(typ, (T.TimestampType, T.TimestampNTZType)):
            at = F.timestamp_add("MINUTE", (self.i % 23) * 60 + self.i % 59, F.lit(BASE_DATE).cast("timestamp_ntz"))
            return F.timestamp_add("DAY", -self.draw(name, 0, 730), at)
        if c.is_integer:
            if kind == "date_key" or name.endswith("date_key"):
                return fn.cyclic_date_key(self.i)
            return self.draw(name, 1, 25 if parts & {"quantity", "count", "number", "score", "rank"} else 1000)
        if c.is_numeric:
            top = 100 if parts & {"rate", "percentage", "ratio", "score"} else 10_000 if parts & {"amount", "price", "cost", "revenue", "total", "margin", "value"} else 1000
            scale = 2 if c.scale is None else c.scale
            largest = 10 ** (c.precision - scale) * 10**scale - 1 if c.precision is not None else 99_999
            return self.draw(name, 0, min(top * 10**scale, largest)).cast("decimal(38,10)") / F.lit(10**scale)
        if c.base == "uuid":
            return fn.uuid5(F.concat(F.lit(f"{self.entity}.{c.name}."), self.i.cast("string")))
        if c.is_json:
            return F.to_json(F.struct(F.lit(True).alias("generated"), self.i.alias("row_number"), F.lit("synthetic").alias("source")))
        return fn.bounded(self.text(c, name, kind, parts), c.max_length)

    def text(self, c: ColumnSpec, name: str, kind: str, parts: set[str]) -> Column:
        if kind in ("status", "category", "type", "method", "role", "position", "priority", "country", "nationality"):
            if found := reference_list(self.business, self.t.name, c.name, kind):
                return fn.cycle([str(v) for v in found[0]], self.i)
        first, last = self.pick("first_name", FIRST), self.pick("last_name", LAST)
        rules: list[tuple[bool, Callable[[], Column]]] = [
            (kind == "email" or "email" in name, lambda: fn.email(first, last, self.i, c.max_length)),
            (kind == "phone" or "phone" in name, lambda: F.format_string("+1555%07d", self.i)),
            (kind == "address" or "address" in name, lambda: F.concat_ws(" ", self.draw(name, 1, 999).cast("string"), self.pick(name, NOUNS), F.lit("Street"))),
            (kind == "city" or "city" in parts, lambda: self.pick(name, CITIES)),
            (kind in ("country", "nationality") or parts & {"country", "nationality"}, lambda: self.pick(name, COUNTRIES)),
            (name.endswith("_id"), lambda: fn.business_id(c.name, self.i)),
            ("first_name" in name, lambda: first),
            ("last_name" in name, lambda: last),
            (kind == "person_name", lambda: F.concat_ws(" ", first, last)),
            (bool(parts & {"product", "service", "item"}) and "name" in parts, lambda: F.concat_ws(" ", self.pick(name, NOUNS), F.lit(self.title))),
            (bool(parts & {"store", "branch", "location", "company", "organization"}) and "name" in parts, lambda: F.concat_ws(" ", self.pick(name, CITIES), F.lit(self.title))),
            (kind == "status" or "status" in parts, lambda: fn.cycle(STATUSES, self.i)),
            ("segment" in parts, lambda: fn.cycle(SEGMENTS, self.i)),
            (kind == "method" or "method" in parts, lambda: fn.cycle(METHODS, self.i)),
            (kind in ("role", "position"), lambda: fn.cycle(ROLES, self.i)),
            (kind in ("category", "type") or parts & {"category", "type"}, lambda: fn.cycle(TYPES, self.i)),
            ("code" in parts, lambda: F.format_string(f"{self.entity[:3].upper()}%04d", self.i)),
            (kind == "description", lambda: F.concat_ws(" ", F.lit("A note on the"), self.pick(name, NOUNS), F.lit("of"), self.pick(name + "2", CITIES))),
            ("name" in parts, lambda: F.concat_ws(" ", first, last)),
        ]
        return next((make() for fits, make in rules if fits), F.concat_ws(" ", self.pick(name, NOUNS), F.lit(self.title)))


def _in_keys(t: TableSpec, fk: ForeignKey) -> bool:
    return any(set(fk.columns) & set(k) for k in (t.primary_key, *(u.columns for u in t.uniques)))


def _digits(number: Column, sizes: list[int]) -> list[Column]:
    """Mixed radix digits, from 1, of a number from 0."""
    out, size = [], 1
    for m in sizes:
        out.append(F.pmod(F.floor(number / F.lit(size)).cast("long"), F.lit(m)) + 1)
        size *= m
    return out


def _shuffled(number: Column, size: int, *parts) -> Column:
    """A permutation of 0..size-1, another one for other ``parts``: a step that shares no factor with the size, and a hashed start."""
    step = next(u for u in range(max(1, int(size * 0.618)), size + 1) if math.gcd(u, size) == 1) if size < 1 << 31 else 1
    start = F.pmod(F.xxhash64(*(F.lit(p) if isinstance(p, (str, int)) else p for p in parts)), F.lit(size))
    return F.pmod(F.pmod(number * F.lit(step), F.lit(size)) + start, F.lit(size))


def _prime(limit: int) -> int:
    """The largest prime up to a limit of 2 or more."""
    return next(p for p in range(limit, 1, -1) if all(p % d for d in range(2, int(p**0.5) + 1)))


def _parent_numbers(t: TableSpec, n: int, sets: list[list[ForeignKey]], size_of: Callable[[ForeignKey], int], seed: int) -> dict[int, Column]:
    """The parent's row number for each foreign key of keys that hold foreign keys alone, so that every key is distinct.

    Keys that share no foreign key take the mixed radix digits of the row number.  Of
    keys that do, those that all have take the low digits, and what each has besides is a
    permutation of the rest, one for each tuple of what is shared: as many rows as the
    shared tuples times the smallest of the others.  Where nothing is shared by all
    (a chain, a ring) every foreign key is another line of a plane over a prime p, of
    which two always meet in one point: p * p rows.
    """
    out: dict[int, Column] = {}
    row, left = F.col("_row") - 1, [list(x) for x in sets]
    while left:
        group, ids = [left.pop()], set()
        while True:  # all keys that hang together
            ids = {id(fk) for k in group for fk in k}
            more = [k for k in left if ids & {id(fk) for fk in k}]
            if not more:
                break
            group += more
            left = [k for k in left if k not in more]
        shared = [fk for fk in group[0] if all(any(fk is x for x in k) for k in group)]
        rest = [[fk for fk in k if not any(fk is x for x in shared)] for k in group]
        alone = len(ids) == len(shared) + sum(map(len, rest))
        if len(group) == 1 or (shared and alone):
            base = math.prod(map(size_of, shared))
            room = base * min(math.prod(map(size_of, r)) for r in rest)
            out |= {id(fk): d for fk, d in zip(shared, _digits(row, [size_of(fk) for fk in shared]), strict=True)}
            high = F.floor(row / F.lit(base)).cast("long")
            for k, r in enumerate(rest):
                sizes = [size_of(fk) for fk in r]
                number = _shuffled(high, math.prod(sizes), seed, t.name, k, F.pmod(row, F.lit(base))) if len(group) > 1 else high
                out |= {id(fk): d for fk, d in zip(r, _digits(number, sizes), strict=True)}
        else:
            every = list({id(fk): fk for k in group for fk in k}.values())
            least = min(map(size_of, every))
            p = _prime(least) if least > 1 else 1
            room = p * p if p > 1 and len(every) <= p + 1 and all(len(k) > 1 for k in group) else least
            i, j = F.floor(row / F.lit(p)).cast("long"), F.pmod(row, F.lit(p))
            for line, fk in enumerate(every):
                number = row if room == least else i if line == p else F.pmod(i * F.lit(line) + j, F.lit(p))
                out[id(fk)] = number + 1
        if room < n:
            raise CapacityError(f"{t.full_name}: {room} combinations of parents can't fill {n} rows of a key")
    return out


def table_rows(spark: SparkSession, t: TableSpec, n: int, parents: dict[str, tuple[DataFrame, int]], known: dict, seed: int = 12345, business: dict | None = None, reuse: float = 0.0) -> DataFrame:
    """``n`` rows of a table; ``parents``: frames of parent tables with their row number column ``_row``, and their sizes.

    ``reuse``: with 0 parents are taken in turn; else as often as the power law with
    this exponent says, whatever tasks make the rows.
    """
    room = capacity(t)
    if room is not None and room < n:
        raise CapacityError(f"{t.full_name}: a UNIQUE list of {room} allowed values can't fill {n} rows")
    cells = _Cells(t, seed, known, business)
    taken = {c for fk in t.foreign_keys for c in fk.columns}
    keys = [t.primary_key, *(u.columns for u in t.uniques)]
    own = {c for k in keys if k and not set(k) & taken for c in k[-1:]}  # one column makes such a key distinct
    rows = spark.range(1, n + 1).withColumnRenamed("id", "_row")
    sets = []
    for k in keys:
        mine = [fk for fk in t.foreign_keys if set(fk.columns) & set(k)]
        free = [c for c in k if c not in taken]
        if not mine or free:
            own |= set(free[-1:])
        else:
            sets.append(mine)
    digits = _parent_numbers(t, n, sets, lambda fk: parents[fk.parent.lower()][1], seed)

    out: dict[str, Column] = {}
    for c in t.columns:
        if c.name in taken:
            continue
        if c.name in own and any(k.op == "IN" for k in cells.checks(c)):
            value = cells.checked(c)
        elif c.name in own and not (c.is_numeric and cells.checks(c)):
            value = cells.key(c) if c.name in t.primary_key or c.base == "uuid" or c.is_integer or not isinstance(c.spark_type, T.StringType) else _distinct_text(cells, c)
        else:
            checked = cells.checked(c)
            value = checked if checked is not None else cells.value(c)
        out[c.name] = fn.bounded(value.cast("string"), c.max_length) if isinstance(c.spark_type, T.StringType) else _cast(value, c)
    made = rows.select("_row", *(v.alias(c) for c, v in out.items()))
    for fk in t.foreign_keys:
        frame, m = parents[fk.parent.lower()]
        at = digits.get(id(fk))
        if at is None and reuse and m > 1:
            at = _shuffled(fn.power_rank(m, reuse, seed, t.name, ",".join(fk.columns), F.col("_row")) - 1, m, seed, t.name, ",".join(fk.columns)) + 1
        elif at is None:
            at = F.pmod(F.col("_row") - 1, F.lit(max(1, m))) + 1
        side = frame.select(F.col("_row").alias("_at"), *(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)))
        side = side.drop(*(c for c in fk.columns if c in made.columns))
        made = made.withColumn("_of", at).join(side, F.col("_of") == F.col("_at"), "left").drop("_of", "_at")
    return _ordered_dates(made.select("_row", *(F.col(c.name).cast(c.spark_type).alias(c.name) for c in t.columns)))


def _cast(value: Column, c: ColumnSpec) -> Column:
    if isinstance(c.spark_type, T.DecimalType):
        return F.bround(value.cast("decimal(38,10)"), c.spark_type.scale).cast(c.spark_type)
    return value.cast(c.spark_type)


def _distinct_text(cells: _Cells, c: ColumnSpec) -> Column:
    """The usual text with the row number behind it, within the column's length."""
    if c.name.lower().endswith("_id"):
        return fn.business_id(c.name, cells.i)
    tail = F.format_string("-%03d", cells.i)  # with a blank before it, it would read as a placeholder
    head = cells.value(c)
    if c.max_length:
        head = F.substring(head, F.lit(1), F.greatest(F.lit(0), F.lit(c.max_length) - F.length(tail)))
    return F.trim(F.concat(head, tail))


def _ordered_dates(df: DataFrame) -> DataFrame:
    """An end is no earlier than its start; names are read by whole words."""
    kinds = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    for later, earlier in (("end", "start"), ("actual", "promised"), ("delivered", "ordered")):
        for c in kinds:
            if later in words(c):
                other = next((x for x in kinds if [earlier if w == later else w for w in words(c)] == words(x) and kinds[x] == kinds[c]), None)
                if other:
                    df = df.withColumn(c, F.greatest(c, other))
    return df


def generate(spark: SparkSession, model: WarehouseModel, rows: int = 100, seed: int = 12345, business: dict | None = None, plan: Plan | None = None, payload: tuple[str, ...] = ("source_payload",), reuse: float = 0.0) -> dict[str, DataFrame]:
    """Frames of all tables; row counts by profile where there are raw and staging tables, else ``rows`` each; ``reuse`` as in ``table_rows``."""
    from stratalake.operators.derive import calculate

    plan = plan or plan_layers(model)
    sizes = build_profile(model, plan, rows, payload).rows if plan.of(RAW) and plan.of(STAGING) else dict.fromkeys((t.name for t in model.tables), rows)
    known, made = meanings(model), {}
    numbered: dict[str, tuple[DataFrame, int]] = {}
    for t in model.load_order():
        frame = table_rows(spark, t, sizes[t.name], numbered, known, seed, business, reuse)
        kept = calculate(frame)
        numbered[t.name.lower()] = (kept, sizes[t.name])
        made[t.name] = kept
    for s in plan.of(STAGING):  # a raw payload is the staging row it became
        for r in plan.sources(s, RAW):
            column = next((c.name for c in model.table(r).columns if c.is_json and c.name.lower() in payload), None)
            if column:
                body = made[s].select(F.col("_row").alias("_at"), F.to_json(F.struct(*payload_columns(model.table(s))), {"ignoreNullFields": "false"}).alias("_body"))
                of = F.pmod(F.col("_row") - 1, F.lit(max(1, sizes[s]))) + 1
                columns = made[r].columns
                made[r] = made[r].withColumn("_of", of).join(body, F.col("_of") == F.col("_at"), "left").withColumn(column, F.coalesce("_body", column)).select(*columns)
    return {name: df.drop("_row") for name, df in made.items()}
