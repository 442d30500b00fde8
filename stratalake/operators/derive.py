"""Measures that follow from other columns: calculation, repair, order of life-cycle dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.columns import minutes_between
from stratalake.model import words


def _first(df: DataFrame, exact: str, *speaks: str) -> str | None:
    """The column of that name, else the first numeric one of whose name one of these is a whole word."""
    names = {c.lower(): c for c in df.columns}
    if exact in names:
        return names[exact]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return next((c for c in numeric if not set(words(c)).isdisjoint(speaks)), None)


def calculate(df: DataFrame) -> DataFrame:
    """Line totals, revenue, margin, delay and flags, wherever the columns they need are there.

    Names are read by whole words, so ``discount`` is no count and only a column
    named amount or revenue without another part's name is quantity times price.
    """
    names = {c.lower(): c for c in df.columns}
    quantity, price = _first(df, "quantity", "quantity", "count", "sold"), _first(df, "price", "price")
    kinds = {f.name: f.dataType for f in df.schema}
    out = df
    for c in df.columns:
        parts = set(words(c))
        value: Column | None = None
        if quantity and price and c not in (quantity, price) and (c.lower() in ("line_total_amount", "line_total", "total_amount", "amount", "revenue") or "revenue" in parts):
            value = F.col(quantity) * F.col(price)
        elif "margin" in parts and (r := _first(df, "revenue", "revenue")) and (k := _first(df, "cost", "cost")):
            value = F.col(r) - F.col(k)
        elif "delay" in parts and parts & {"minute", "minutes"}:
            actual = next((x for x in df.columns if "actual" in words(x)), names.get("end_time"))
            promised = next((x for x in df.columns if "promised" in words(x)), names.get("start_time"))
            if actual and promised:
                value = minutes_between(F.col(promised), F.col(actual))
        if value is not None:
            scale = kinds[c].scale if isinstance(kinds[c], T.DecimalType) else None
            out = out.withColumn(c, (F.bround(value, scale) if scale is not None else value).cast(kinds[c]))
    delay = next((x for x in out.columns if "delay" in words(x) and set(words(x)) & {"minute", "minutes"}), None)
    for c in ("is_delayed", "delayed_flag"):
        if delay and c in names:
            out = out.withColumn(names[c], F.coalesce(F.col(delay) > 0, F.lit(False)).cast(kinds[names[c]]))
    end = next((names[x] for x in ("effective_end_date", "end_date", "effective_to") if x in names), None)
    for c in ("is_current", "current_flag"):
        if end and c in names:
            out = out.withColumn(names[c], F.col(end).isNull().cast(kinds[names[c]]))
    return out


def repair_metrics(df: DataFrame) -> DataFrame:
    """Delayed counts and flags from the delay, available and short quantities from their parts; a missing delay is none."""
    has, kinds = set(df.columns), {f.name: f.dataType for f in df.schema}
    delay = next((c for c in ("delivery_delay_minutes", "delay_minutes") if c in has), None)
    late = F.coalesce(F.col(delay).try_cast("double") > 0, F.lit(False)) if delay else F.lit(False)
    fixed: dict[str, Column] = {c: late.cast("int") for c in ("delayed_delivery_count", "delayed_count") if c in has}
    if "is_delayed" in has:
        fixed["is_delayed"] = late
    for name, a, b in (("available_quantity", "on_hand_quantity", "reserved_quantity"), ("short_received_quantity", "ordered_quantity", "received_quantity")):
        if {name, a, b} <= has:  # an operand that is missing leaves the value as it is
            fixed[name] = F.coalesce(F.col(a) - F.col(b), F.col(name))
    return df.withColumns({c: v.cast(kinds[c]) for c, v in fixed.items()}) if fixed else df


def order_dates(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """``later`` is at least ``earlier``; nulls stay."""
    return df.withColumn(later, F.when(F.col(later) < F.col(earlier), F.col(earlier)).otherwise(F.col(later)))


def mirror_after(df: DataFrame, promised: str, actual: str) -> DataFrame:
    """An actual time before the promised one is put as far after it, so delays are never negative."""
    gap = F.timestamp_diff("SECOND", F.col(actual), F.col(promised))
    return df.withColumn(actual, F.when(F.col(actual) < F.col(promised), F.timestamp_add("SECOND", gap, F.col(promised))).otherwise(F.col(actual)))
