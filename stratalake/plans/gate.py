"""Admission of stored ELT statements by their parsed plan, and their execution.

Statements are parsed by Spark's own parser and judged by the tree: the root
must insert from a query without overwriting, the target must belong to the
statement's layer, every table that the tree reads must be one of the model or
a CTE in scope, and it may call functions of some groups of built-in ones
alone.  The tree may hold the nodes and expressions of ``PLANS`` and
``EXPRESSIONS`` and no others, so what isn't known here (scripts, identifiers made
of strings, parameters, time travel, whatever a later parser adds) is refused.
Words in strings or comments mean nothing, and nothing can hide from it in a comma
join or a second statement.  What runs is the query of the tree that was judged,
never the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import ParseException

from stratalake.model import TableSpec, WarehouseModel
from stratalake.operators.elt import fit_to_table
from stratalake.plans.layers import DIMENSION, FACT, RAW, STAGING, Plan
from stratalake.plans.profile import Profile

#: The parts of a specification, and the layer that each statement list fills.
PARTS = ("load_table_rows", "staging_sql", "dimension_sql", "fact_sql", "assumptions")
LAYERS = {"staging_sql": STAGING, "dimension_sql": DIMENSION, "fact_sql": FACT}
#: Catalog schemas that are never read.
SYSTEM = {"information_schema", "pg_catalog", "sys", "system"}
#: Groups of built-in functions that statements may call; others (reflection, session facts, errors, user-defined ones) are refused.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "date_funcs", "datetime_funcs", "generator_funcs",
    "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "window_funcs",
}


#: Nodes that a parsed query may hold.
PLANS = set("""
    Aggregate CTERelationDef Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit Offset OneRowRelation Pivot Project Sort SubqueryAlias Union
    Unpivot UnresolvedHaving UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith
    WithWindowDefinition
""".split())  # fmt: skip
#: Expressions that it may hold, by their class; calls by name are judged by name.
EXPRESSIONS = set("""
    Add Alias And BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat Cube CurrentDate CurrentRow CurrentTimestamp DateAddInterval Divide EqualNullSafe EqualTo Exists
    ExpressionPosition GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNotUnknown IsNull IsUnknown LambdaFunction LateralSubquery LessThan
    LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply NamedStruct Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery ShiftLeft ShiftRight
    ShiftRightUnsigned SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive
    UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal
    UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition
""".split())  # fmt: skip


#: Takes a table's name, what makes its rows and what they are made from, and returns them as they were written (now, or before from the same).
Settle = Callable[[str, Callable[[], DataFrame], str], DataFrame]


@dataclass
class Statement:
    """What a parsed statement does."""

    sql: str
    kind: str
    target: str | None = None
    target_columns: list[str] = field(default_factory=list)
    reads: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    table_calls: list[str] = field(default_factory=list)
    strange: list[str] = field(default_factory=list)
    overwrite: bool = False
    by_name: bool = False
    query: object = None


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


class _Reader:
    """Collects what a parsed plan reads and calls, and what it holds that isn't admitted."""

    def __init__(self):
        self.reads: list[str] = []
        self.calls: list[str] = []
        self.table_calls: list[str] = []
        self.strange: list[str] = []

    def plan(self, node, in_scope: frozenset[str] = frozenset()) -> None:
        name = node.nodeName()
        if name not in PLANS:
            self.strange.append(name)
            return
        if name == "UnresolvedRelation":
            said = ".".join(_each(node.multipartIdentifier())).lower()
            if said not in in_scope:
                self.reads.append(said)
            if node.isStreaming() or not node.options().isEmpty():
                self.strange.append(f"options of {said}")
        elif name == "UnresolvedWith":
            self.plan(node.child(), self.ctes(node, in_scope))
        else:
            if name == "UnresolvedTableValuedFunction":
                self.table_calls.append(".".join(_each(node.name())).lower())
            for e in _each(node.expressions()):
                self.expression(e, in_scope)
            for child in _each(node.children()):
                self.plan(child, in_scope)

    def ctes(self, node, in_scope: frozenset[str]) -> frozenset[str]:
        """Read the definitions of a WITH; returns the names in scope after it."""
        for pair in _each(node.cteRelations()):
            alias = pair._1().lower()
            self.plan(pair._2(), in_scope | {alias} if node.allowRecursion() else in_scope)
            in_scope = in_scope | {alias}
        return in_scope

    def expression(self, e, in_scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName().rstrip("$")
        if kind not in EXPRESSIONS:
            self.strange.append(kind)
            return
        if kind == "UnresolvedFunction":
            self.calls.append(".".join(_each(e.nameParts())).lower())
        elif kind == "UnresolvedGenerator":
            self.calls.append(e.name().unquotedString().lower())
        elif "Subquery" in kind and kind != "InSubquery" or kind in ("Exists", "ListQuery"):
            self.plan(e.plan(), in_scope)
        for child in _each(e.children()):
            self.expression(child, in_scope)

    def reasons(self, spark: SparkSession) -> list[str]:
        """Why nothing that holds this may run."""
        out = [f"holds {name}, which isn't admitted" for name in dict.fromkeys(self.strange)]
        out += [f"calls {name}, which isn't admitted" for name in dict.fromkeys(self.calls) if function_group(spark, name) not in FUNCTION_GROUPS]
        return out + [f"reads the table function {name}" for name in dict.fromkeys(self.table_calls) if function_group(spark, name) != "generator_funcs"]


def parse(spark: SparkSession, sql: str) -> Statement:
    """Target, tables and functions of a statement; ``kind`` is insert, or the root's name for anything else."""
    root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    reader, scope, withs = _Reader(), frozenset(), []
    while root.nodeName() == "UnresolvedWith":
        scope = reader.ctes(root, scope)
        withs.append(root)
        root = root.child()
    if root.nodeName() != "InsertIntoStatement":
        return Statement(sql, root.nodeName())
    query = root.query()
    if query.nodeName() in ("UnresolvedInlineTable", "LocalRelation"):
        return Statement(sql, "INSERT ... VALUES")
    reader.plan(query, scope)
    if root.table().nodeName() != "UnresolvedRelation":
        return Statement(sql, f"INSERT INTO {root.table().nodeName()}")
    if not root.partitionSpec().isEmpty():
        reader.strange.append("a partition of its target")
    for outer in reversed(withs):  # the query alone, under the definitions of the statement
        query = outer.withNewChildren(spark.sparkContext._jvm.PythonUtils.toSeq([query]))
    target = ".".join(_each(root.table().multipartIdentifier())).lower()
    return Statement(sql, "insert", target, _each(root.userSpecifiedCols()), reader.reads, reader.calls, reader.table_calls, reader.reasons(spark), root.overwrite(), root.byName(), query)


def function_group(spark: SparkSession, name: str) -> str | None:
    """The group of a built-in function; none for any other name."""
    catalyst = spark.sparkContext._jvm.org.apache.spark.sql.catalyst
    found = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else None


def judge(spark: SparkSession, sql: str, role: str, model: WarehouseModel, plan: Plan) -> list[str]:
    """Reasons against a statement of a layer; none if it is admitted."""
    try:
        s = parse(spark, sql)
    except ParseException as e:
        return [f"can't be parsed: {str(e).splitlines()[0]}"]
    if s.kind != "insert":
        return [f"{s.kind} isn't an INSERT ... SELECT"]
    out = ["overwrites its target"] if s.overwrite else []
    target = model.find(s.target or "")
    if target is None or plan.roles.get(target.name) != role:
        out.append(f"target {s.target} isn't a {role} table of the model")
    for name in dict.fromkeys(s.reads):
        if name.split(".")[0] in SYSTEM:
            out.append(f"reads system schema {name}")
        elif model.find(name) is None:
            out.append(f"reads {name}, which isn't in the model")
    return out + s.strange


def judge_spec(spark: SparkSession, spec: dict, model: WarehouseModel, plan: Plan, profile: Profile | None = None) -> list[str]:
    """Reasons against a whole specification: its shape, its raw rows, its statements."""
    if missing := [p for p in PARTS if p not in spec]:
        return [f"missing: {', '.join(missing)}"]
    out = [f"{p} must be a list of texts" for p in LAYERS if not isinstance(spec[p], list) or not all(isinstance(s, str) for s in spec[p])]
    rows = spec["load_table_rows"]
    if not isinstance(rows, dict):
        out.append("load_table_rows must map tables to rows")
    if not isinstance(spec["assumptions"], list):
        out.append("assumptions must be a list")
    if out:
        return out
    raw = plan.of(RAW)
    for name, given in rows.items():
        t = model.find(name)
        if t is None or t.name not in raw:
            out.append(f"{name} isn't a raw table")
            continue
        if not isinstance(given, list) or not all(isinstance(r, dict) for r in given):
            out.append(f"{name}: rows must be a list of objects")
            continue
        for strange in sorted({k for r in given for k in r if not t.has(k)}):
            out.append(f"{name} has no column {strange}")
        if profile and len(given) != profile.rows[t.name]:
            out.append(f"{name}: {profile.rows[t.name]} rows expected, {len(given)} given")
    given = {t.name for n in rows if (t := model.find(n))}
    out += [f"{name} has no rows" for name in raw if name not in given]
    for part, role in LAYERS.items():
        for k, sql in enumerate(spec[part], 1):
            out += [f"{part} {k}: {reason}" for reason in judge(spark, sql, role, model, plan)]
    return out


_SPAN = re.compile(r"(?P<keep>'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<a>\"(?:[^\"]|\"\")+\"|[A-Za-z_]\w*)\s*\.\s*(?P<b>\"(?:[^\"]|\"\")+\"|[A-Za-z_]\w*)", re.DOTALL)


def unqualify(sql: str, model: WarehouseModel, schema: str | None = None) -> str:
    """Schema-qualified names of the model's tables without their schema (or with ``schema``), outside strings and comments."""

    def swap(m: re.Match) -> str:
        if m["keep"]:
            return m.group()
        a, b = (x.strip('"') for x in (m["a"], m["b"]))
        t = model.find(f"{a}.{b}")
        if t is None or (t.schema or "").lower() != a.lower():
            return m.group()
        return f"{schema}.{t.name}" if schema else t.name

    return _SPAN.sub(swap, sql)


def execute(spark: SparkSession, spec: dict, model: WarehouseModel, plan: Plan, raw: dict[str, DataFrame], settle: Settle | None = None, saved=None, sources: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Frames of all tables: raw ones as given, then each admitted statement's query, staging before dimensions before facts.

    Inserts into one table add up; columns that a statement doesn't name get
    defaults or numbers.  With ``settle`` every table of a layer is written before the
    next layer begins, which then reads what was written; without it frames are
    chained and nothing is written.  With ``saved`` (``sources.ledger.Saved``) the rows
    are to be added: numbers go on, and statements see dimensions with the rows that
    were saved before, but other layers as this run brings them.

    What a table is made from, as ``settle`` gets it, is a fingerprint over the parsed
    plans of its statements and the fingerprints of the tables that they read; those of
    raw tables are ``sources``.
    """
    made: dict[str, DataFrame] = {}
    of = dict(sources or {})

    def show(name: str, role: str) -> None:
        whole = role == DIMENSION and saved is not None and saved.table(name) is not None
        (saved.rows(name).unionByName(made[name]) if whole else made[name]).createOrReplaceTempView(name)

    for name, df in raw.items():
        made[name] = settle(name, lambda df=df: df, of.get(name, "")) if settle else df
        show(name, RAW)
    for part, role in LAYERS.items():
        collected: dict[str, tuple[TableSpec, DataFrame]] = {}
        fitted: set[str] = set()
        statements: list[Statement] = []

        def fit(name: str, collected=collected, fitted=fitted, role=role, statements=statements) -> None:
            t, rows = collected[name]
            make = lambda: fit_to_table(rows, t, saved=saved)
            mine = [x for x in statements if model.table(x.target).name == name]
            below = {b.name: of.get(b.name, "") for x in mine for r in x.reads if (b := model.find(r))}
            plans = [(re.sub(r"#\d+", "#", x.query.toString()), x.target_columns, x.by_name) for x in mine]
            of[name] = hashlib.sha256(json.dumps([plans, below], sort_keys=True).encode()).hexdigest() if all(below.values()) else ""
            made[name] = settle(name, make, of[name]) if settle else make()
            fitted.add(name)
            show(name, role)

        for sql in spec[part]:
            plain = unqualify(sql, model)
            if reasons := judge(spark, plain, role, model, plan):
                raise ValueError(f"{part}: {reasons[0]}")
            statements.append(parse(spark, plain))
        for k, s in enumerate(statements):
            for name in {t.name for r in s.reads if (t := model.find(r))} & collected.keys() - fitted:
                if any(model.table(x.target).name == name for x in statements[k:]):
                    raise ValueError(f"{part}: {name} is read before all its rows are there")
                fit(name)
            t = model.table(s.target)
            query = _frame(spark, s.query)
            df = query if s.by_name else query.toDF(*(s.target_columns or t.column_names[: len(query.columns)]))
            if strange := [c for c in df.columns if not t.has(c)]:
                raise ValueError(f"{part}: {t.name} has no column {', '.join(strange)}")
            collected[t.name] = (t, collected[t.name][1].unionByName(df, allowMissingColumns=True) if t.name in collected else df)
        for name in collected.keys() - fitted:
            fit(name)
    return made


def _frame(spark: SparkSession, plan) -> DataFrame:
    """A parsed plan as a frame."""
    return DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def make_views(spark: SparkSession, queries: dict[str, str], model: WarehouseModel, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames of view queries over the tables of a model and over earlier views.

    A query that reads anything else, or calls what statements may not call, is an error.
    """
    made: dict[str, DataFrame] = {}
    for name, df in data.items():
        df.createOrReplaceTempView(name)
    for name, sql in queries.items():
        root, reader = spark._jsparkSession.sessionState().sqlParser().parsePlan(unqualify(sql, model)), _Reader()
        reader.plan(root)
        strange = [f"reads {r}" for r in reader.reads if r not in {v.lower() for v in made} and ((t := model.find(r)) is None or t.name not in data)]
        strange += reader.reasons(spark)
        if strange:
            raise ValueError(f"view {name}: {', '.join(strange)}")
        made[name] = _frame(spark, root)
        made[name].createOrReplaceTempView(name)
    return made
