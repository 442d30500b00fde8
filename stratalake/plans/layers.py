"""Which layer each table belongs to, and which tables feed it.

Only names, columns and keys of the model are looked at.  Each layer has an
ordered list of ways to find a source: an equal entity name first, then the
best-scoring candidate of the layer below.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from stratalake.model import TableSpec, WarehouseModel

RAW, STAGING, DIMENSION, FACT, OTHER = "raw_load", "staging", "dimension", "fact", "other"
ROLES = (RAW, STAGING, DIMENSION, FACT, OTHER)
#: Columns that carry load bookkeeping, as lineage sees them.
TECHNICAL = {"batch_id", "load_id", "load_row_id", "source_payload", "source_file", "loaded_at", "staged_at", "created_at", "updated_at"}
#: Endings of business keys.
KEY_ENDINGS = ("_id", "_code", "_number", "_no")


def role_of(name: str) -> str:
    n = name.lower()
    if n.startswith("load_") or n.endswith("_raw"):
        return RAW
    prefixes = {"stg": STAGING, "dim": DIMENSION, "fact": FACT}
    return prefixes.get(n.split("_", 1)[0], OTHER) if "_" in n else OTHER


def entity(name: str) -> str:
    """The thing a table is about: its name without layer marks, some plurals made singular."""
    n = re.sub(r"^(?:load|stg|dim|fact)_", "", name.lower()).removesuffix("_raw")
    return n[:-1] if n.endswith(("_details", "_items", "_events")) else n


def lineage_columns(t: TableSpec) -> set[str]:
    return {c.name.lower() for c in t.columns} - TECHNICAL


def planner_keys(t: TableSpec) -> set[str]:
    """Business keys for lineage: neither part of the primary key nor technical."""
    return {n for n in lineage_columns(t) if n.endswith(KEY_ENDINGS)} - {k.lower() for k in t.primary_key}


@dataclass(frozen=True)
class Plan:
    roles: dict[str, str]
    lineage: dict[str, list[str]] = field(default_factory=dict)
    primary: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def of(self, role: str) -> list[str]:
        return [t for t, r in self.roles.items() if r == role]

    def sources(self, table: str, role: str) -> list[str]:
        return [s for s in self.lineage.get(table, []) if self.roles.get(s) == role]


def _best(candidates: Iterable[TableSpec], score: Callable[[TableSpec], tuple | None]) -> str | None:
    scored = [(s, t.name) for t in candidates if (s := score(t)) is not None]
    return max(scored)[1] if scored else None


def plan_layers(model: WarehouseModel, semantic_roles: dict[str, str] | None = None, override: dict[str, list[str]] | None = None) -> Plan:
    """Roles and lineage; ``override`` names a table's sources, the primary one first, where the rules guess wrong."""
    given = semantic_roles or {}
    roles = {t.name: r if (r := given.get(t.name)) in (RAW, STAGING, DIMENSION, FACT) else role_of(t.name) for t in model.tables}
    plan = Plan(roles)
    layer = {r: [t for t in model.tables if roles[t.name] == r] for r in ROLES}

    def same_entity(t: TableSpec, below: str) -> str | None:
        named = [x.name for x in layer[below] if entity(x.name) == entity(t.name)]
        return min(named, key=len, default=None)

    def staging_source(t: TableSpec):
        mine = lineage_columns(t)

        def score(raw: TableSpec):
            keys, shared = len(planner_keys(raw) & mine), len(lineage_columns(raw) & mine)
            return (keys, shared) if keys or shared >= 2 else None

        return same_entity(t, RAW) or _best(layer[RAW], score)

    def dimension_source(t: TableSpec):
        keys = planner_keys(t)
        return same_entity(t, STAGING) or _best(layer[STAGING], lambda s: (n,) if (n := len(keys & lineage_columns(s))) else None)

    def fact_source(t: TableSpec):
        mine = lineage_columns(t)

        def score(s: TableSpec):
            keys, shared = len(planner_keys(s) & mine), len(lineage_columns(s) & mine)
            return (keys, shared, -len(entity(s.name))) if keys or shared >= 2 else None

        return same_entity(t, STAGING) or _best(layer[STAGING], score)

    find = {STAGING: staging_source, DIMENSION: dimension_source, FACT: fact_source}
    for role in (STAGING, DIMENSION, FACT):
        for t in layer[role]:
            if override and t.name in override:
                sources = list(override[t.name])
                primary = next((s for s in sources if roles.get(s) != DIMENSION), sources[0] if sources else None)
            else:
                primary = find[role](t)
                sources = [fk.parent for fk in t.foreign_keys if roles.get(fk.parent) == DIMENSION] if role == FACT else []
                if primary:
                    sources.append(primary)
                    if role == FACT:  # and what the event needs to be put together
                        sources += [fk.parent for fk in model.table(primary).foreign_keys if roles.get(fk.parent) == STAGING]
            plan.lineage[t.name] = list(dict.fromkeys(sources))
            if primary:
                plan.primary[t.name] = primary
            if not sources:
                plan.warnings.append(f"{t.name}: no source was found")
    return plan
