"""Rules that look at a schema, a specification or a business input: each case against its expected row."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.catalogue import LAYERED_DDL, MODEL
from stratalake.catalogue_flows import SHOP, STATEMENTS
from stratalake.operators import checks
from stratalake.operators.generate import CapacityError, generate
from stratalake.plans import gate, semantics
from stratalake.plans.layers import plan_layers
from stratalake.plans.profile import build_profile, capacity, required_payload
from stratalake.sources import catalog, intake, sinks, spec
from stratalake.sources.ddl import extract_ddl, extract_views, parse_ddl

BUSINESS = {
    "business_name": "Corner Shop", "business_type": "retail", "business_description": "sells watches and repairs them", "model_purpose": "reporting of sales analysis",
    "main_business_processes": ["sales"], "key_business_entities": ["Customer", "SalesOrder", "Payment"], "business_relationships": ["a customer places orders"],
    "entity_attributes": {"SalesOrder": ["order_date", "quantity", "unit_price"]}, "reporting_requirements": ["sales by day"], "expected_output": "SQL DDL",
    "target_database": "warehouse", "db_password": "x", "reference_data": {"order_statuses": ["Open", "Done"], "customer_segments": ["A", "B"], "payment_methods": ["Card"]},
}
REVIEW = dict.fromkeys(intake.REVIEW_FIELDS, []) | {"ai_review_score": 87}
ANSWER = {"status": "ok", "final_output_markdown": "CREATE TABLE dim_a (id int);", "ai_additions_and_assumptions": []}


def _fails(f, *args) -> bool:
    try:
        f(*args)
    except intake.InputError:
        return True
    return False


def intake_fields(spark, sf):
    """Required fields, points and final score of inputs with some fields left out."""
    inputs = {"whole": BUSINESS, "no name": BUSINESS | {"business_name": " "}, "no database": {k: v for k, v in BUSINESS.items() if k != "target_database"}, "empty": {}}
    rows = []
    for name, data in inputs.items():
        score = intake.rule_score(data)[0]
        rows.append((name, len(intake.missing_fields(data)), score, *intake.final_score(score, 87)))
    return spark.createDataFrame(rows, "input string, missing long, points long, final_score double, decision string")


def intake_intents(spark, sf):
    inputs = {
        "named": {"target_model_type": "Star Schema"}, "alias": {"target_model_type": "OLTP"}, "words": BUSINESS, "reports alone": {"reporting_requirements": ["x"]}, "storage": {"model_purpose": "a CRUD application"},
        "nothing": {}, "layers": {"target_model_type": "warehouse", "required_layers": "fact, staging"},
    }
    rows = [(k, i["model_type"], i["modeling_style"], ",".join(i["required_layers"]), i["fact_dimension_inference_required"], i["confidence"]) for k, d in inputs.items() for i in [intake.intent(d)]]
    return spark.createDataFrame(rows, "input string, model_type string, style string, layers string, inferred boolean, confidence string")


def intake_blueprint(spark, sf):
    plan = intake.blueprint(BUSINESS, intake.intent(BUSINESS))
    rows = [(part, k, x) for part in ("load_tables", "staging_tables", "dimension_tables", "fact_tables", "measures", "dimension_keys", "mapping") for k, x in enumerate(plan[part])]
    return spark.createDataFrame(rows + [("grain", k, g) for k, g in enumerate(plan["fact_grains"].values())], "part string, position long, value string")


def intake_responses(spark, sf):
    """Stored responses that are refused, and texts against what was asked for."""
    wanted = intake.intent(BUSINESS)
    good = "".join(f"CREATE TABLE {p}x (id int);\n" for p in ("dim_", "fact_", "load_", "stg_")) + intake.ASSUMPTIONS_HEADING
    rows = [(f"review: {k}", str(_fails(intake.check_review, REVIEW | change)).lower()) for k, change in {"good": {}, "score 101": {"ai_review_score": 101}, "score true": {"ai_review_score": True}, "suggestions text": {"suggestions": "x"}}.items()]
    rows += [(f"generation: {k}", str(_fails(intake.check_generation, ANSWER | change)).lower()) for k, change in {"good": {}, "blank": {"final_output_markdown": " "}, "no list": {"ai_additions_and_assumptions": "x"}}.items()]
    rows += [(f"json: {k}", str(_fails(intake.read_json, text)).lower()) for k, text in {"fenced": '```json\n{"a": 1}\n```', "plain": "[1]", "broken": "{a"}.items()]
    rows += [(f"text: {k}", intake.output_quality(text, wanted, {"fact_tables": ["fact_sales"]})[0]) for k, text in {"good": good + " reporting fact_sales", "no reporting": good, "empty": ""}.items()]
    rows.append(("redacted keys", ",".join(sorted(set(BUSINESS) - set(intake.redact(BUSINESS))))))
    return spark.createDataFrame(rows, "case string, result string")


def column_meanings(spark, sf):
    rows = [(t, c, m.kind, m.confidence) for (t, c), m in semantics.meanings(MODEL).items() if t in ("customer", "orders", "events", "nation")]
    return spark.createDataFrame(rows, "table_name string, column_name string, meaning string, confidence double")


def meaning_histogram(spark, sf):
    return spark.createDataFrame(list(semantics.meaning_histogram(parse_ddl(LAYERED_DDL)).items()), "meaning string, columns long")


def reference_lists(spark, sf):
    asked = [("stg_order", "order_status", "status"), ("dim_customer", "segment", "category"), ("stg_customer", "customer_segment", None), ("fact_payment", "method", "method"), ("dim_store", "colour", None), ("stg_order", "status", "status")]
    rows = [(t, c, k, got[1] if got else None) for t, c, k in asked for got in [semantics.reference_list(BUSINESS, t, c, k)]]
    return spark.createDataFrame(rows, "table_name string, column_name string, meaning string, list string")


def names_and_terms(spark, sf):
    """Slugs, name spaces, singular and snake-case words, important words, table roles."""
    def protected(name):
        try:
            return sinks.target_namespace("x", explicit=name)
        except ValueError:
            return "refused"

    rows = [("slug", x, sinks.slug(x)) for x in ("Ada's 1st Shop!", "2 go", "", "a" * 60)]
    rows += [("namespace", x, protected(x)) for x in ("Shop 1", "public", "pg_x", "default")]
    rows += [("singular", x, semantics.singular(x)) for x in ("categories", "statuses", "orders", "gas", "class")]
    rows += [("snake", x, intake.snake(x)) for x in ("SalesOrder", "web session", "HTTPServer", "--")]
    rows += [("role", x, semantics.table_role(x)) for x in ("load_x", "s.stg_x", "dim_x", "fact_x", "x_raw")]
    rows.append(("terms", "business", " ".join(semantics.important_terms(semantics.flatten([BUSINESS["business_name"], BUSINESS["business_description"], BUSINESS["model_purpose"]])))))
    return spark.createDataFrame(rows, "rule string, given string, result string")


def gate_decisions(spark, sf):
    """Statements of the staging layer, each admitted or not."""
    rows = [(k, not gate.judge(spark, sql, "staging", SHOP, plan_layers(SHOP))) for k, sql in GATED.items()]
    return spark.createDataFrame(rows, "statement string, admitted boolean")


_TO = "INSERT INTO stg_order (order_id, customer_id)"
GATED = {
    "insert select": f"{_TO} SELECT load_id, 1 FROM load_order_raw", "common table": f"WITH c AS (SELECT load_id FROM load_order_raw) {_TO} SELECT load_id, 1 FROM c",
    "comment first": f"-- INSERT INTO old\n{_TO} SELECT load_id, 1 FROM load_order_raw", "words in text": f"{_TO} SELECT load_id, length('DROP TABLE x; DELETE') FROM load_order_raw",
    "lateral generator": f"{_TO} SELECT load_id, x FROM load_order_raw, LATERAL explode(array(1, 2)) AS t (x)", "overwrite": "INSERT OVERWRITE TABLE stg_order SELECT load_id, 1, 2 FROM load_order_raw",
    "reflection": f"{_TO} SELECT load_id, reflect('java.lang.System', 'nanoTime') FROM load_order_raw", "table function": f"{_TO} SELECT id, id FROM range(10)",
    "unknown function": f"{_TO} SELECT load_id, own(load_id) FROM load_order_raw", "user": f"{_TO} SELECT load_id, length(current_user()) FROM load_order_raw", "values": f"{_TO} VALUES (1, 2)",
    "select": "SELECT * FROM load_order_raw", "drop": "DROP TABLE stg_order", "update": "UPDATE stg_order SET order_id = 1", "other layer": "INSERT INTO fact_order SELECT load_id, 1, 2, 3 FROM load_order_raw",
    "comma join": f"{_TO} SELECT load_id, 1 FROM load_order_raw, secrets", "system schema": f"{_TO} SELECT 1, 2 FROM information_schema.tables", "in a subquery": f"{_TO} SELECT load_id, (SELECT max(x) FROM hidden) FROM load_order_raw",
    "two statements": f"{_TO} SELECT 1, 2; DROP TABLE stg_order", "file": f"{_TO} SELECT 1, 2 FROM json.`/tmp/x`", "nonsense": "INSERT INTO",
}



def spec_decisions(spark, sf):
    """Specifications as a whole: shape, raw rows, counts against the profile."""
    plan = plan_layers(SHOP)
    profile = build_profile(SHOP, plan, 2)
    rows = {t: [{"source_payload": "{}"}] * profile.rows[t] for t in plan.of("raw_load")}
    whole = STATEMENTS | {"load_table_rows": rows, "assumptions": []}
    cases = {
        "whole": whole, "part missing": {k: v for k, v in whole.items() if k != "fact_sql"}, "no list": whole | {"staging_sql": "x"}, "unknown column": whole | {"load_table_rows": rows | {"load_order_raw": [{"z": 1}] * profile.rows["load_order_raw"]}},
        "not raw": whole | {"load_table_rows": rows | {"stg_order": []}}, "row short": whole | {"load_table_rows": rows | {"load_order_raw": rows["load_order_raw"][1:]}}, "raw table missing": whole | {"load_table_rows": {"load_order_raw": rows["load_order_raw"]}},
        "no objects": whole | {"load_table_rows": rows | {"load_order_raw": [1]}}, "statement": whole | {"fact_sql": ["DROP TABLE x"]},
    }
    return spark.createDataFrame([(k, len(gate.judge_spec(spark, c, SHOP, plan, profile))) for k, c in cases.items()], "specification string, reasons long")


def profile_rules(spark, sf):
    """Capacities, required payload keys, relationships, the span of dates; keys of a stored specification."""
    model = parse_ddl("CREATE TABLE stg_x (x_id text PRIMARY KEY, code text UNIQUE CHECK (code IN ('a', 'b', 'b')), note text NOT NULL DEFAULT 'n', size integer NOT NULL, free text)")
    rows = [("capacity", "stg_x", str(capacity(model.tables[0]))), ("required", "stg_x", ",".join(required_payload(model.tables[0])))]
    for base in (1, 10, 500):
        rows.append(("date span", str(base), str(build_profile(SHOP, plan_layers(SHOP), base).date_span_days)))
    layered = parse_ddl(LAYERED_DDL)
    for r in build_profile(layered, plan_layers(layered), 10).relationships:
        rows.append(("relationship", f"{r.child_raw} -> {r.parent_raw}", f"{','.join(r.child_columns)} reuse={r.require_reuse} single={r.one_to_one}"))
    rows.append(("same fingerprint", "order of keys", str(spec.fingerprint({"a": 1, "b": 2}) == spec.fingerprint({"b": 2, "a": 1}) != spec.fingerprint({"a": 2, "b": 1}))))
    return spark.createDataFrame(rows, "rule string, subject string, result string")


def schema_rules(spark, sf):
    """Statements found in markdown, views, load order, undeclared keys, CREATE statements of the catalog."""
    text = f"# Design\n```sql\nCREATE SCHEMA s;\n{LAYERED_DDL}\nCREATE VIEW v AS SELECT 1;\nCREATE INDEX i ON stg_order (order_id);\n```\nCREATE TABLE outside (id int);"
    model = parse_ddl(extract_ddl(text))
    rows = [("tables", 0, str(len(model.tables))), ("views", 0, ",".join(extract_views(text)))]
    rows += [("load order", k, t.name) for k, t in enumerate(parse_ddl("CREATE TABLE c (id int PRIMARY KEY, b_id int REFERENCES b); CREATE TABLE b (id int PRIMARY KEY, a_id int REFERENCES a); CREATE TABLE a (id int PRIMARY KEY)").load_order())]
    rows += [("undeclared", k, f"{t}.{c}") for k, (t, c) in enumerate(checks.undeclared_keys(model))]
    rows.append(("create", 0, catalog.create_statement(model.table("stg_customer"), "shop")))
    return spark.createDataFrame(rows, "rule string, position long, result string")


def check_status(spark, sf):
    """The status of some sets of check results."""
    row = lambda severity, n: ("c", "t", "x", severity, n, None)
    cases = {"clean": [row("error", 0), row("warning", 0)], "warned": [row("error", 0), row("warning", 2)], "failed": [row("error", 1), row("warning", 2)], "noted": [row("info", 1)], "none": []}
    out = None
    for name, rows in cases.items():
        one = checks.status(spark.createDataFrame(rows, checks.RESULT)).select(F.lit(name).alias("case"), "status", "errors", "warnings")
        out = one if out is None else out.unionAll(one)
    return out


def profile_row_counts(spark, sf):
    model = parse_ddl(LAYERED_DDL)
    rows = build_profile(model, plan_layers(model), 10).rows
    return spark.createDataFrame([(t.name, rows[t.name]) for t in model.tables], "table_name string, row_count long")


def lineage_plan(spark, sf):
    model = parse_ddl(LAYERED_DDL)
    plan = plan_layers(model)
    return spark.createDataFrame([(t, plan.roles[t], k, s, s == plan.primary.get(t)) for t, ss in plan.lineage.items() for k, s in enumerate(ss)], "table_name string, role string, position long, source string, is_primary boolean")


def generation_limits(spark, sf):
    """Whether constraints leave room for some numbers of rows."""
    tables = {
        "three allowed values": "CREATE TABLE x (id bigint PRIMARY KEY, code text UNIQUE CHECK (code IN ('a', 'b', 'c')))",
        "pairs of parents": "CREATE TABLE a (id bigint PRIMARY KEY, k text UNIQUE CHECK (k IN ('p', 'q', 'r'))); CREATE TABLE x (one bigint REFERENCES a, two bigint REFERENCES a, UNIQUE (one, two))",
    }
    rows = []
    for name, ddl in tables.items():
        for n in (3, 4):
            try:
                made = generate(spark, parse_ddl(ddl), n, 1)["x"].count()
            except CapacityError:
                made = None
            rows.append((name, n, made))
    return spark.createDataFrame(rows, "room string, wanted long, made long")


QUERIES = {
    f.__name__: f
    for f in (
        intake_fields, intake_intents, intake_blueprint, intake_responses, column_meanings, meaning_histogram, reference_lists, names_and_terms, gate_decisions, spec_decisions,
        profile_rules, schema_rules, check_status, profile_row_counts, lineage_plan, generation_limits,
    )
}
#: What each case must give; columns with types, then rows.
EXPECTED = {
    "intake_fields": (
        "input VARCHAR, missing BIGINT, points BIGINT, final_score DOUBLE, decision VARCHAR",
        [
            ('whole', 0, 100, 96.1, 'ready_for_generation'), ('no name', 1, 95, 92.6, 'ready_for_generation'),
            ('no database', 1, 95, 92.6, 'ready_for_generation'), ('empty', 9, 0, 26.1, 'needs_improvement'),
        ],
    ),
    "intake_intents": (
        "input VARCHAR, model_type VARCHAR, style VARCHAR, layers VARCHAR, inferred BOOLEAN, confidence VARCHAR",
        [
            ('named', 'star_schema', 'star_schema', 'raw_load,staging,dimension,fact,reporting', True, 'high'),
            ('alias', 'operational_model', 'normalized_relational', 'operational', False, 'high'),
            ('words', 'analytical_data_warehouse', 'dimensional_model', 'raw_load,staging,dimension,fact,reporting', True, 'high'),
            ('reports alone', 'analytical_data_warehouse', 'dimensional_model', 'raw_load,staging,dimension,fact,reporting', True, 'medium'),
            ('storage', 'operational_model', 'normalized_relational', 'operational', False, 'medium'),
            ('nothing', 'operational_model', 'normalized_relational', 'operational', False, 'low'),
            ('layers', 'analytical_data_warehouse', 'dimensional_model', 'fact,staging', True, 'high'),
        ],
    ),
    "intake_blueprint": (
        "part VARCHAR, position BIGINT, value VARCHAR",
        [
            ('load_tables', 0, 'load_customer_raw'), ('load_tables', 1, 'load_sales_order_raw'), ('load_tables', 2, 'load_payment_raw'),
            ('staging_tables', 0, 'stg_customer'), ('staging_tables', 1, 'stg_sales_order'), ('staging_tables', 2, 'stg_payment'),
            ('dimension_tables', 0, 'dim_customer'), ('dimension_tables', 1, 'dim_date'), ('fact_tables', 0, 'fact_sales'),
            ('fact_tables', 1, 'fact_payment'), ('measures', 0, 'quantity'), ('measures', 1, 'unit_price'), ('measures', 2, 'price'),
            ('measures', 3, 'order_total_amount'), ('dimension_keys', 0, 'customer_key'), ('dimension_keys', 1, 'date_key'),
            ('mapping', 0, 'Customer -> load_customer_raw -> stg_customer'), ('mapping', 1, 'SalesOrder -> load_sales_order_raw -> stg_sales_order'),
            ('mapping', 2, 'Payment -> load_payment_raw -> stg_payment'), ('grain', 0, 'one row per order item'),
            ('grain', 1, 'one row per payment transaction'),
        ],
    ),
    "intake_responses": (
        "case VARCHAR, result VARCHAR",
        [
            ('review: good', 'false'), ('review: score 101', 'true'), ('review: score true', 'true'), ('review: suggestions text', 'true'),
            ('generation: good', 'false'), ('generation: blank', 'true'), ('generation: no list', 'true'), ('json: fenced', 'false'),
            ('json: plain', 'false'), ('json: broken', 'true'), ('text: good', 'passed'), ('text: no reporting', 'passed_with_warnings'),
            ('text: empty', 'failed'), ('redacted keys', 'db_password'),
        ],
    ),
    "column_meanings": (
        "table_name VARCHAR, column_name VARCHAR, meaning VARCHAR, confidence DOUBLE",
        [
            ('nation', 'n_nationkey', 'surrogate_key', 0.95), ('nation', 'n_name', 'text', 0.45), ('nation', 'n_regionkey', 'foreign_key', 0.95),
            ('customer', 'c_custkey', 'surrogate_key', 0.95), ('customer', 'c_name', 'text', 0.45), ('customer', 'c_nationkey', 'foreign_key', 0.95),
            ('customer', 'c_acctbal', 'amount', 0.55), ('customer', 'c_mktsegment', 'category', 0.85),
            ('orders', 'o_orderkey', 'surrogate_key', 0.95), ('orders', 'o_custkey', 'foreign_key', 0.95),
            ('orders', 'o_orderstatus', 'status', 0.85), ('orders', 'o_totalprice', 'amount', 0.85), ('orders', 'o_orderdate', 'date', 0.85),
            ('orders', 'o_orderpriority', 'priority', 0.85), ('events', 'event_id', 'business_key', 0.95), ('events', 'ts', 'timestamp', 0.8),
            ('events', 'user_id', 'foreign_key', 0.95), ('events', 'event_type', 'type', 0.85), ('events', 'value', 'amount', 0.55),
            ('events', 'props', 'json', 0.95),
        ],
    ),
    "meaning_histogram": (
        "meaning VARCHAR, columns BIGINT",
        [
            ('business_key', 9), ('date', 1), ('foreign_key', 4), ('json', 3), ('person_name', 2), ('quantity', 2), ('surrogate_key', 3),
            ('timestamp', 4),
        ],
    ),
    "reference_lists": (
        "table_name VARCHAR, column_name VARCHAR, meaning VARCHAR, list VARCHAR",
        [
            ('stg_order', 'order_status', 'status', 'order_statuses'), ('dim_customer', 'segment', 'category', 'customer_segments'),
            ('stg_customer', 'customer_segment', None, 'customer_segments'), ('fact_payment', 'method', 'method', 'payment_methods'),
            ('dim_store', 'colour', None, None), ('stg_order', 'status', 'status', 'order_statuses'),
        ],
    ),
    "names_and_terms": (
        "rule VARCHAR, given VARCHAR, result VARCHAR",
        [
            ('slug', "Ada's 1st Shop!", 'ada_s_1st_shop'), ('slug', '2 go', 'uc_2_go'), ('slug', '', 'use_case'),
            ('slug', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'),
            ('namespace', 'Shop 1', 'shop_1'), ('namespace', 'public', 'refused'), ('namespace', 'pg_x', 'refused'),
            ('namespace', 'default', 'refused'), ('singular', 'categories', 'category'), ('singular', 'statuses', 'status'),
            ('singular', 'orders', 'order'), ('singular', 'gas', 'gas'), ('singular', 'class', 'clas'), ('snake', 'SalesOrder', 'sales_order'),
            ('snake', 'web session', 'web_session'), ('snake', 'HTTPServer', 'http_server'), ('snake', '--', 'entity'),
            ('role', 'load_x', 'raw_load'), ('role', 's.stg_x', 'staging'), ('role', 'dim_x', 'dimension'), ('role', 'fact_x', 'fact'),
            ('role', 'x_raw', 'operational'), ('terms', 'business', 'corner shop sells watches repairs them sales'),
        ],
    ),
    "gate_decisions": (
        "statement VARCHAR, admitted BOOLEAN",
        [
            ('insert select', True), ('common table', True), ('comment first', True), ('words in text', True), ('lateral generator', True),
            ('overwrite', False), ('reflection', False), ('table function', False), ('unknown function', False), ('user', False), ('values', False),
            ('select', False), ('drop', False), ('update', False), ('other layer', False), ('comma join', False), ('system schema', False),
            ('in a subquery', False), ('two statements', False), ('file', False), ('nonsense', False),
        ],
    ),
    "spec_decisions": (
        "specification VARCHAR, reasons BIGINT",
        [
            ('whole', 0), ('part missing', 1), ('no list', 1), ('unknown column', 1), ('not raw', 1), ('row short', 1), ('raw table missing', 1),
            ('no objects', 1), ('statement', 1),
        ],
    ),
    "profile_rules": (
        "rule VARCHAR, subject VARCHAR, result VARCHAR",
        [
            ('capacity', 'stg_x', '2'), ('required', 'stg_x', 'x_id,size'), ('date span', '1', '30'), ('date span', '10', '40'),
            ('date span', '500', '365'), ('relationship', 'load_order_raw -> load_customer_raw', 'customer_id reuse=True single=False'),
            ('relationship', 'load_order_item_raw -> load_order_raw', 'order_id reuse=True single=False'),
            ('same fingerprint', 'order of keys', 'True'),
        ],
    ),
    "schema_rules": (
        "rule VARCHAR, position BIGINT, result VARCHAR",
        [
            ('tables', 0, '9'), ('views', 0, 'v'), ('load order', 0, 'a'), ('load order', 1, 'b'), ('load order', 2, 'c'),
            ('undeclared', 0, 'dim_customer.customer_id'), ('undeclared', 1, 'fact_order.order_id'),
            ('undeclared', 2, 'fact_order_item.order_item_id'),
            ('create', 0, "CREATE TABLE IF NOT EXISTS `shop`.`stg_customer` (`customer_id` string NOT NULL, `customer_name` string NOT NULL, `staged_at` timestamp) USING parquet COMMENT 'PRIMARY KEY (customer_id)'"),
        ],
    ),
    "check_status": (
        "case VARCHAR, status VARCHAR, errors BIGINT, warnings BIGINT",
        [
            ('clean', 'passed', 0, 0), ('warned', 'passed_with_warnings', 0, 1), ('failed', 'failed', 1, 1), ('noted', 'passed', 0, 0),
            ('none', 'passed', 0, 0),
        ],
    ),
}


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of some rows of fixed values."""
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names = [f'"{c.split()[0]}"' for c in columns.split(", ")]
    cast = ", ".join(f"{n}::{c.split()[1]} AS {n}" for n, c in zip(names, columns.split(", "), strict=True))
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") t ({', '.join(names)})"


SQL = {name: _values(*expected) for name, expected in EXPECTED.items()}
SQL |= {
    "profile_row_counts": """SELECT * FROM (VALUES ('load_customer_raw', 5::BIGINT), ('load_order_raw', 10), ('load_order_item_raw', 30), ('stg_customer', 5), ('stg_order', 10), ('stg_order_item', 30),
      ('dim_customer', 5), ('fact_order', 10), ('fact_order_item', 30)) t(table_name, row_count)""",
    "lineage_plan": """SELECT * FROM (VALUES ('stg_customer', 'staging', 0::BIGINT, 'load_customer_raw', true), ('stg_order', 'staging', 0, 'load_order_raw', true), ('stg_order_item', 'staging', 0, 'load_order_item_raw', true),
      ('dim_customer', 'dimension', 0, 'stg_customer', true), ('fact_order', 'fact', 0, 'dim_customer', false), ('fact_order', 'fact', 1, 'stg_order', true), ('fact_order', 'fact', 2, 'stg_customer', false),
      ('fact_order_item', 'fact', 0, 'dim_customer', false), ('fact_order_item', 'fact', 1, 'stg_order_item', true), ('fact_order_item', 'fact', 2, 'stg_order', false)) t(table_name, role, position, source, is_primary)""",
    "generation_limits": """
SELECT room, wanted::BIGINT AS wanted, made::BIGINT AS made
FROM (VALUES ('three allowed values', 3, 3), ('three allowed values', 4, NULL), ('pairs of parents', 3, 3), ('pairs of parents', 4, NULL)) t (room, wanted, made)""",
}
