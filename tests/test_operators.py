"""Checks, generation, derived measures, statement gate, sinks and functions on small frames."""

import datetime as dt
import json
import uuid
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratalake.functions import columns as fn
from stratalake.model import ColumnSpec
from stratalake.operators import checks, derive, elt, generate
from stratalake.plans import gate
from stratalake.plans.layers import plan_layers
from stratalake.plans.profile import build_profile
from stratalake.plans.semantics import meanings
from stratalake.sources import sinks
from stratalake.sources.ddl import parse_ddl


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def found(df):
    return {(r["check_id"], r["table_name"], r["columns"]): r["violations"] for r in df.collect()}


# Checks


def test_foreign_keys_skip_missing_parts(spark):
    m = parse_ddl("create table p (a int, b text, primary key (a, b)); create table c (id int primary key, x int, y text, foreign key (x, y) references p)")
    p, c = frame(spark, "a int, b string", (1, "k")), frame(spark, "id int, x int, y string", (1, 1, None), (2, 1, ""), (3, 9, "k"), (4, 1, "k"))
    got = found(checks.validate(m, {"p": p, "c": c}))
    assert got["foreign_key", "c", "x, y -> p(a, b)"] == 1
    stats = checks.reuse(c, ("x", "y"), p, ("a", "b")).first()
    assert (stats["child_rows"], stats["skipped"], stats["unresolved"], stats["parents_used"]) == (4, 2, 1, 2)


def test_row_checks_in_one_pass(spark):
    t = parse_ddl("create table x (id int primary key, name varchar(5) not null, status text check (status in ('A', 'B')), n numeric(4,2) check (n between 1 and 10), q int check (q > 0), t time, other_name text)").tables[0]
    df = frame(
        spark, "id string, name string, status string, n string, q int, t string, other_name string", ("1", "abcdef", "C", "1.234", 0, "25:00", "customer_001"), ("x", "", "", "123", None, "12:30", "Sales Item 0001"), ("3", None, "A", None, 5, None, "fine"),
    )
    got = found(checks.row_checks(t, df, expected=2))
    want = {
        ("row_count", "*"): 1, ("required", "id"): 0, ("required", "name"): 2, ("length", "name"): 1, ("type", "id"): 1, ("type", "n"): 0, ("digits", "n"): 2, ("type", "t"): 1, ("check", "status"): 1,
        ("check", "n"): 1, ("check", "q"): 1, ("placeholder", "other_name"): 1, ("semantic_placeholder", "other_name"): 1,
    }
    assert {k: got[k[0], "x", k[1]] for k in want} == want


def test_keys_and_status(spark):
    df = frame(spark, "a int, b int", (1, None), (1, None), (2, 1), (2, 1), (3, 1))
    assert checks.duplicate_keys(df, "a", "b").count() == 2 and checks.duplicate_keys(df, "a", "b", nulls_distinct=True).count() == 1
    m = parse_ddl("create table x (a int primary key, other_id int, code text unique)")
    got = checks.validate(m, {"x": frame(spark, "a int, other_id int, code string", (1, 1, "u"), (2, 2, "u"))})
    assert found(got)["unique", "x", "code"] == 1 and found(got)["undeclared_key", "x", "other_id"] == 1 and checks.status(got).first()["status"] == "failed"
    fine = checks.validate(m, {"x": frame(spark, "a int, other_id int, code string", (1, 1, "u"), (2, 2, "v"))}, {"x": 2})
    assert checks.status(fine).first()["status"] == "passed_with_warnings"
    assert checks.status(checks.validate(m, {"x": frame(spark, "a int, other_id int, code string")}, {"x": 1}, at_least=True)).first()["errors"] == 1


LAYERS = """create table load_customer_raw (load_id int primary key, source_payload jsonb not null, loaded_at timestamptz default now()); create table load_order_raw (like load_customer_raw including all);
create table stg_customer (customer_id text primary key, customer_name text not null); create table stg_order (order_id text primary key, customer_id text not null references stg_customer, amount numeric(10,2));
create table dim_customer (customer_key bigint primary key, customer_id text unique, customer_name text); create table fact_order (order_key bigint primary key, customer_key bigint references dim_customer, order_id text, amount numeric(10,2));"""
SPEC = {
    "load_table_rows": {
        "load_customer_raw": [{"source_payload": '{"customer_id": "C1", "customer_name": "Ada"}'}, {"source_payload": '{"customer_id": "C2", "customer_name": "Bo"}'}],
        "load_order_raw": [{"source_payload": f'{{"order_id": "O{k}", "customer_id": "C{k % 2 + 1}", "amount": "{k}.50"}}'} for k in range(4)],
    },
    "staging_sql": [
        "INSERT INTO stg_customer (customer_id, customer_name) SELECT get_json_object(source_payload, '$.customer_id'), get_json_object(source_payload, '$.customer_name') FROM load_customer_raw",
        "INSERT INTO stg_order (order_id, customer_id, amount) SELECT p.order_id, p.customer_id, p.amount FROM (SELECT from_json(source_payload, 'order_id string, customer_id string, amount decimal(10,2)') p FROM load_order_raw)",
    ],
    "dimension_sql": ["INSERT INTO dim_customer (customer_id, customer_name) SELECT customer_id, customer_name FROM stg_customer"],
    "fact_sql": ["WITH o AS (SELECT * FROM stg_order WHERE customer_id IS DISTINCT FROM 'DROP TABLE x') INSERT INTO fact_order (customer_key, order_id, amount) SELECT customer_key, order_id, amount FROM o JOIN dim_customer d ON d.customer_id = o.customer_id"],
    "assumptions": [],
}


def test_lineage_reads_keys_from_payloads(spark):
    m = parse_ddl(LAYERS)
    plan = plan_layers(m)
    data = gate.execute(spark, SPEC, m, plan, {t: elt.from_rows(spark, m.table(t), rows) for t, rows in SPEC["load_table_rows"].items()})
    assert checks.status(checks.validate_lineage(m, data, plan)).first()["status"] == "passed"
    data["stg_order"] = data["stg_order"].withColumn("customer_id", F.lit("C9"))
    data["fact_order"] = data["fact_order"].withColumn("customer_key", F.lit(99))
    got = found(checks.validate_lineage(m, data, plan))
    assert got["staging_in_raw", "stg_order", "customer_id in load_order_raw"] == 1 and got["fact_in_dimension", "fact_order", "customer_key -> dim_customer(customer_key)"] == 4


def test_realism(spark):
    m = parse_ddl("create table p (id int primary key); create table c (id int primary key, p_id int references p, day date)")
    start = dt.date(2024, 1, 1)
    p = frame(spark, "id int", (1,), (2,))
    c = frame(spark, "id int, p_id int, day date", *((k, k % 2 + 1, start + dt.timedelta(k // 4)) for k in range(12)))
    got = found(checks.validate_realism(m, {"p": p, "c": c}))
    assert got["temporal_span", "*", "at least 7 days"] == 1 and got["reference", "c", "p_id -> p"] == 0 and got["reuse", "c", "p_id -> p"] == 0 and got["uniform_counts", "*", "row counts"] == 0


def test_payload_checks(spark):
    m = parse_ddl(LAYERS)
    profile = build_profile(m, plan_layers(m), 10)
    raw = frame(spark, "source_payload string", ('{"a": 1, "b": null}',), ("[1]",), ("no json",), ('{"b": 2}',), (None,))
    assert found(checks.payload_checks("r", raw, ["a", "b"])) == {("payload_object", "r", "source_payload"): 3, ("payload_key", "r", "a"): 1, ("payload_key", "r", "b"): 0}
    data = {"load_customer_raw": frame(spark, "source_payload string", ('{"customer_id": "1"}',), ('{"customer_id": "2"}',)), "load_order_raw": frame(spark, "source_payload string", ('{"customer_id": "1"}',), ("{}",), ('{"customer_id": "7"}',))}
    got = found(checks.payload_references(profile, data))
    assert got["payload_reference", "load_order_raw", "customer_id -> load_customer_raw"] == 2 and got["payload_reuse", "load_order_raw", "customer_id -> load_customer_raw"] == 1


def test_distinct_and_reused_keys_of_payloads(spark):
    raw = frame(spark, "source_payload string", ('{"k": 1}',), ('{"k": 1}',), ('{"k": "1"}',), ('{"k": 2}',), ("{}",), (None,))
    assert tuple(checks.payload_keys(raw, "k").first()) == (6, 3, 2) and tuple(checks.payload_keys(raw.limit(0), "k").first()) == (0, 0, 0)


# Gate


def test_spec_is_admitted_and_executed(spark):
    m = parse_ddl(LAYERS)
    plan = plan_layers(m)
    assert gate.judge_spec(spark, SPEC, m, plan) == []
    data = gate.execute(spark, SPEC, m, plan, {t: elt.from_rows(spark, m.table(t), rows) for t, rows in SPEC["load_table_rows"].items()})
    assert {(r["order_id"], r["customer_key"], r["amount"]) for r in data["fact_order"].collect()} == {(f"O{k}", k % 2 + 1, Decimal(f"{k}.50")) for k in range(4)}
    assert [r["order_key"] for r in data["fact_order"].orderBy("order_key").collect()] == [1, 2, 3, 4] and data["load_order_raw"].filter("load_id is null or loaded_at is null").count() == 0
    assert checks.status(checks.validate(m, data, {t: n for t, n in (("fact_order", 4), ("dim_customer", 2))})).first()["errors"] == 0


@pytest.mark.parametrize("sql,why", [
    ("INSERT INTO dim_customer SELECT 1, 'a', 'b' FROM stg_customer", "target"), ("DROP TABLE stg_order", "isn't an INSERT"), ("TRUNCATE TABLE stg_order", "isn't an INSERT"), ("SELECT 1", "isn't an INSERT"),
    ("INSERT INTO stg_order SELECT * FROM load_order_raw, secrets", "secrets"), ("INSERT INTO stg_order SELECT * FROM information_schema.tables", "system schema"), ("INSERT INTO", "parsed"),
    ("WITH c AS (SELECT * FROM hidden) INSERT INTO stg_order SELECT * FROM c", "hidden"), ("INSERT INTO stg_order SELECT * FROM load_order_raw WHERE EXISTS (SELECT 1 FROM elsewhere)", "elsewhere"),
    ("INSERT INTO stg_order SELECT order_id FROM load_order_raw; INSERT INTO stg_order SELECT 1", "parsed"), ("INSERT OVERWRITE TABLE stg_order SELECT * FROM load_order_raw", "overwrites"),
    ("INSERT INTO stg_order SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "reflect"), ("INSERT INTO stg_order SELECT id FROM range(10)", "range"),
    ("INSERT INTO stg_order SELECT own_function(load_id) FROM load_order_raw", "own_function"), ("INSERT INTO stg_order VALUES ('a')", "INSERT ... VALUES isn't"),
    ("INSERT INTO stg_order SELECT * FROM load_order_raw, LATERAL (SELECT current_user())", "current_user"),
    ("INSERT INTO stg_order (order_id, customer_id) SELECT TRANSFORM(load_id, load_id) USING 'cat' AS (a bigint, b bigint) FROM load_order_raw", "ScriptTransformation"),
    ("INSERT INTO stg_order SELECT x, x FROM IDENTIFIER('json.`/any/file`')", "Unresolved"), ("INSERT INTO stg_order SELECT 1 FROM IDENTIFIER('secrets')", "Unresolved"),
    ("INSERT INTO stg_order SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')", "Unresolved"), ("INSERT INTO IDENTIFIER('stg_order') SELECT 1", "UnresolvedIdentifier isn't an INSERT"),
    ("INSERT INTO stg_order PARTITION (order_id = 5) SELECT 1 FROM load_order_raw", "partition"), ("INSERT INTO stg_order SELECT 1 FROM (VALUES (1), (2)) t", "LocalRelation"),
    ("INSERT INTO stg_order SELECT 1 FROM load_order_raw VERSION AS OF 3", "TimeTravel"), ("INSERT INTO stg_order SELECT * FROM load_order_raw TABLESAMPLE (10 PERCENT)", "Sample"),
    ("INSERT INTO stg_order SELECT (SELECT max(x) FROM IDENTIFIER('secrets')) FROM load_order_raw", "Unresolved"), ("INSERT INTO stg_order SELECT :p FROM load_order_raw", "NamedParameter"),
    ("INSERT INTO stg_order WITH c AS (FROM IDENTIFIER('secrets')) SELECT * FROM c", "Unresolved"), ("INSERT INTO stg_order SELECT 1 FROM STREAM load_order_raw", "options"),
    ("INSERT INTO stg_order SELECT transform(array(1), x -> reflect('a', 'b')) FROM load_order_raw", "reflect"),
    ("INSERT INTO stg_order REPLACE WHERE true SELECT 1", "isn't an INSERT"), ("CREATE TABLE t AS SELECT 1", "isn't an INSERT"), ("SET spark.a = 1", "isn't an INSERT"),
])
def test_statements_that_are_refused(spark, sql, why):
    m = parse_ddl(LAYERS)
    reasons = gate.judge(spark, sql, "staging", m, plan_layers(m))
    assert any(why in r for r in reasons)


@pytest.mark.parametrize("query", [
    "SELECT a.customer_id, CASE WHEN b.order_id IS NULL THEN 'x' ELSE coalesce(b.order_id, '-') END FROM stg_customer a LEFT JOIN stg_order b ON a.customer_id = b.customer_id AND b.amount BETWEEN 1 AND 2",
    "SELECT customer_id, sum(amount) FILTER (WHERE amount > 0) AS s FROM stg_order GROUP BY customer_id HAVING count(*) >= 1 ORDER BY s DESC NULLS LAST LIMIT 5",
    "SELECT row_number() OVER (PARTITION BY customer_id ORDER BY amount ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), rank() OVER w FROM stg_order WINDOW w AS (ORDER BY amount)",
    "SELECT DISTINCT trim(BOTH ' ' FROM customer_id), customer_id || '-' || order_id, CAST(amount AS int) % 2, -amount, amount DIV 2, NOT amount > 1 FROM stg_order WHERE customer_id IN ('a', 'b') OR order_id LIKE 'O%' OR order_id RLIKE '^O'",
    "SELECT customer_id FROM stg_customer UNION ALL SELECT customer_id FROM stg_order EXCEPT SELECT 'x' INTERSECT SELECT 'y'",
    "SELECT e.value, transform(array(1, 2), x -> x + 1)[0] FROM load_order_raw r, LATERAL (SELECT r.load_id AS value) e WHERE EXISTS (SELECT 1 FROM stg_order s WHERE s.order_id = r.load_id) AND r.load_id IN (SELECT order_id FROM stg_order)",
    "SELECT customer_id, grouping(customer_id), count(DISTINCT order_id) FROM stg_order GROUP BY ROLLUP (customer_id)",
    "SELECT extract(YEAR FROM DATE '2024-01-02'), date_add(current_date, 1), INTERVAL 1 DAY + DATE '2024-01-01', current_timestamp, substring(customer_id FROM 2), position('a' IN customer_id), named_struct('a', 1).a FROM stg_customer",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t",
    "SELECT o.order_id, l.x FROM stg_order o LATERAL VIEW OUTER explode(split(o.order_id, ',')) l AS x",
])
def test_ordinary_queries_are_admitted(spark, query):
    m = parse_ddl(LAYERS)
    assert gate.judge(spark, f"INSERT INTO stg_order {query}", "staging", m, plan_layers(m)) == []


def test_columns_by_name(spark):
    m = parse_ddl(LAYERS)
    plan = plan_layers(m)
    raw = {"load_order_raw": elt.from_rows(spark, m.table("load_order_raw"), SPEC["load_table_rows"]["load_order_raw"])}
    spec = {"staging_sql": ["INSERT INTO stg_order BY NAME SELECT 2.5 AS amount, 'O' || load_id AS order_id, 'c' AS customer_id FROM load_order_raw WHERE load_id = 1"], "dimension_sql": [], "fact_sql": []}
    assert [(r["order_id"], r["customer_id"], r["amount"]) for r in gate.execute(spark, spec, m, plan, raw)["stg_order"].collect()] == [("O1", "c", Decimal("2.50"))]
    with pytest.raises(ValueError, match="no column strange"):
        gate.execute(spark, spec | {"staging_sql": ["INSERT INTO stg_order BY NAME SELECT 1 AS strange FROM load_order_raw"]}, m, plan, raw)


def test_views_hold_admitted_nodes_alone(spark):
    m = parse_ddl(LAYERS)
    for sql in ("SELECT TRANSFORM(customer_id) USING 'cat' AS (a) FROM stg_customer", "SELECT 1 FROM IDENTIFIER('json.`/x`')", "DROP TABLE stg_customer"):
        with pytest.raises(ValueError, match="isn't admitted"):
            gate.make_views(spark, {"v": sql}, m, {"stg_customer": frame(spark, "customer_id string", ("a",))})


def test_what_runs_is_the_judged_query(spark):
    """Comments, common table expressions at the root and generators; no table of the catalog is touched."""
    m = parse_ddl(LAYERS)
    plan = plan_layers(m)
    parts = {"staging_sql": [
        "-- INSERT INTO old (a) SELECT 1\nINSERT INTO stg_customer SELECT 'C1', 'INSERT INTO x'", "WITH a AS (SELECT 'C' AS c), b AS (SELECT concat(c, x) AS id FROM a LATERAL VIEW explode(array(2, 3)) t AS x) INSERT INTO stg_customer (customer_name, customer_id) SELECT 'n', id FROM b",
    ], "dimension_sql": [], "fact_sql": []}
    data = gate.execute(spark, parts, m, plan, {})
    assert sorted(map(tuple, data["stg_customer"].collect())) == [("C1", "INSERT INTO x"), ("C2", "n"), ("C3", "n")]
    spark.sql("DROP TABLE IF EXISTS stg_order")
    with pytest.raises(ValueError, match="overwrites"):
        gate.execute(spark, {"staging_sql": ["INSERT OVERWRITE TABLE stg_order SELECT customer_id, 'a', 1 FROM stg_customer"], "dimension_sql": [], "fact_sql": []}, m, plan, {})


def test_spec_shape(spark):
    m = parse_ddl(LAYERS)
    plan = plan_layers(m)
    assert gate.judge_spec(spark, {"staging_sql": []}, m, plan)[0].startswith("missing")
    wrong = SPEC | {"load_table_rows": {"load_customer_raw": [{"nope": 1}], "stg_order": []}}
    said = " ".join(gate.judge_spec(spark, wrong, m, plan, build_profile(m, plan, 10)))
    assert "no column nope" in said and "stg_order isn't a raw table" in said and "load_order_raw has no rows" in said and "rows expected" in said


def test_names_lose_their_schema_outside_strings():
    m = parse_ddl("create table raw.load_x (id int); create table dw.dim_x (id int)")
    sql = "INSERT INTO dw.dim_x SELECT 'raw.load_x', \"raw\".load_x.id -- raw.load_x\nFROM raw . load_x JOIN other.load_x"
    assert gate.unqualify(sql, m) == "INSERT INTO dim_x SELECT 'raw.load_x', load_x.id -- raw.load_x\nFROM load_x JOIN other.load_x"
    assert gate.unqualify("FROM raw.load_x", m, "uc_1") == "FROM uc_1.load_x"


# Generation


def test_generated_rows_satisfy_their_model(spark):
    m = parse_ddl("""create table dim_place (id int primary key, city text, region text, country text, unique (city, region, country)); create table customer (customer_id text primary key, name varchar(12) not null, email varchar(18), code uuid, status text check (status in ('A', 'B')));
      create table sales_order (order_id text primary key, customer_id text references customer not null, start_date date, end_date date, quantity int check (quantity > 0), unit_price numeric(8,2) check (unit_price >= 1), line_total numeric(12,2));
      create table line (k bigint, order_id text references sales_order, place int references dim_place, primary key (order_id, place), score numeric(3,1) check (score between 1 and 5), flag boolean, t time, at timestamptz, j jsonb);""")
    data = generate.generate(spark, m, 60)
    got = checks.validate(m, data, dict.fromkeys(data, 60), meanings(m))
    bad = [r for r in got.collect() if r["violations"] and r["severity"] == "error"]
    assert not bad
    order = data["sales_order"].filter("end_date < start_date or line_total <> quantity * unit_price")
    assert order.count() == 0 and data["customer"].orderBy("customer_id").first()["customer_id"] == "CUST-000001"
    again = generate.generate(spark, m, 60)
    assert data["customer"].exceptAll(again["customer"]).count() == 0


def test_layers_share_values_and_payloads_equal_staging(spark):
    m = parse_ddl(LAYERS)
    data = generate.generate(spark, m, 10)
    assert {t: df.count() for t, df in data.items()} == build_profile(m, plan_layers(m), 10).rows
    names = {r["customer_id"]: r["customer_name"] for r in data["stg_customer"].collect()}
    assert all(names.get(r["customer_id"], r["customer_name"]) == r["customer_name"] for r in data["dim_customer"].collect())
    staged = sorted((r["order_id"], r["customer_id"]) for r in data["stg_order"].collect())
    assert staged == sorted((p["order_id"], p["customer_id"]) for r in data["load_order_raw"].collect() for p in [json.loads(r["source_payload"])])


def test_room_is_checked_before_rows_are_made(spark):
    with pytest.raises(generate.CapacityError):
        generate.generate(spark, parse_ddl("create table x (id int primary key, s text unique check (s in ('a', 'b')))"), 3)
    with pytest.raises(generate.CapacityError):
        generate.table_rows(spark, parse_ddl("create table p (id int primary key); create table x (a int references p, unique (a))").tables[1], 3, {"p": (spark.range(1, 3).withColumnRenamed("id", "_row").withColumn("id", F.col("_row")), 2)}, {})


# Derived measures


def test_repair_and_calculation(spark):
    df = frame(spark, "delivery_delay_minutes int, delayed_count int, is_delayed boolean, available_quantity int, on_hand_quantity int, reserved_quantity int, short_received_quantity int, ordered_quantity int, received_quantity int", (5, 0, False, 0, 10, 3, 0, 8, 6), (None, 7, True, 1, None, 3, 9, 1, 1))
    a, b = derive.repair_metrics(df).orderBy(F.desc("delivery_delay_minutes")).collect()
    assert (a["delayed_count"], a["is_delayed"], a["available_quantity"], a["short_received_quantity"]) == (1, True, 7, 2)
    assert (b["delayed_count"], b["is_delayed"], b["available_quantity"], b["short_received_quantity"]) == (0, False, 1, 0)
    t = frame(spark, "quantity int, unit_price decimal(10,2), line_total decimal(12,2), discount_amount decimal(5,2), effective_end_date date, is_current boolean", (3, Decimal("2.50"), None, Decimal("1.00"), None, False))
    r = derive.calculate(t).first()
    assert (r["line_total"], r["discount_amount"], r["is_current"]) == (Decimal("7.50"), Decimal("1.00"), True)
    at = lambda h: dt.datetime(2024, 1, 1, h)
    r = derive.mirror_after(frame(spark, "p timestamp_ntz, a timestamp_ntz", (at(10), at(8))), "p", "a").first()
    assert r["a"] == at(12) and derive.order_dates(frame(spark, "a date, b date", (dt.date(2024, 2, 1), dt.date(2024, 1, 1))), "a", "b").first()["b"] == dt.date(2024, 2, 1)


def test_functions(spark):
    one = spark.range(1, 2)
    got = one.select(
        fn.uuid5(F.lit("python.org")).alias("u"), fn.business_id("shop_order_id", F.col("id")).alias("b"), fn.quantise(F.lit(Decimal("2.345")), 2).alias("q"), fn.email(F.lit("Ada"), F.lit("O'Neil"), F.col("id")).alias("e"),
        fn.minutes_between(F.lit(dt.datetime(2024, 1, 1, 2)), F.lit(dt.datetime(2024, 1, 1, 1))).alias("m"), fn.coerce(F.lit("12.7"), ColumnSpec("n", "integer")).alias("i"), fn.coerce(F.lit("zz"), ColumnSpec("d", "date")).alias("d"),
        fn.coerce(F.lit("YES"), ColumnSpec("f", "boolean")).alias("f"), fn.coerce(F.lit("abcdef"), ColumnSpec("s", "varchar(3)", max_length=3)).alias("s"), fn.coerce(F.lit("2.345"), ColumnSpec("x", "numeric(5,2)", precision=5, scale=2)).alias("x"),
    ).first()
    assert got["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org")) and got["b"] == "SHOPORDER-20260706-000001" and got["q"] == Decimal("2.34") and got["e"] == "ada.oneil.001@example.com"
    assert (got["m"], got["i"], got["d"], got["f"], got["s"], got["x"]) == (0, 12, dt.date(2026, 7, 6), True, "abc", Decimal("2.34"))


def test_row_numbers_in_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).union(spark.createDataFrame([(None,)], "k long"))
    got = elt.number_rows(df, "n", "k").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1002)) and [r["k"] for r in got] == [*range(1000), None]


def test_delay_between_start_and_end(spark):
    df = frame(spark, "start_time timestamp, end_time timestamp, delay_minutes long", (dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 8, 30), 0), (dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 7), 9))
    assert [r["delay_minutes"] for r in derive.calculate(df).collect()] == [30, 0]


def test_text_keys_are_numbered_by_ranges_in_files(spark):
    """Numbers follow the order of text keys over many files, without one task for all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, "k string, file_of_row string", *((f"k{k * 7919 % 1000:04d}", "x") for k in range(1000)), (None, "x")).repartition(5)
        got = elt.number_rows(df, "n", "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got.inputFiles()) > 1 and got.columns == ["k", "file_of_row", "n"] and "SinglePartition" not in got._jdf.queryExecution().toString()
    assert [(r["k"], r["n"]) for r in got.orderBy("n").collect()] == [*((f"k{k:04d}", k + 1) for k in range(1000)), (None, 1001)]
    assert elt.number_rows(df.limit(0), "n", "k").count() == 0


def test_dimension_takes_one_whole_row_a_key(spark):
    df = frame(spark, "id int, a string, b string", (2, "y", "1"), (2, "x", "2"), (1, None, "q"), (1, "z", "p"), (3, "w", None)).repartition(4)
    assert [tuple(r) for r in elt.dimension(df, "key", "id", "a", "b").orderBy("key").collect()] == [(1, 1, None, "q"), (2, 2, "x", "2"), (3, 3, "w", None)]


def test_rows_with_their_own_columns(spark):
    t = parse_ddl("create table load_x (id int primary key, body jsonb not null, n int default 7, at date)").tables[0]
    got = elt.from_rows(spark, t, [{"body": {"a": 1}}, {"id": 9, "body": "{}", "n": None}, {"body": "[]", "n": 3, "at": "2024-01-02"}]).collect()
    assert [tuple(r) for r in got] == [(1, '{"a": 1}', 7, None), (9, "{}", None, None), (2, "[]", 3, dt.date(2024, 1, 2))]
    for bad in ([{"id": 1}], [{"body": "{}", "z": 1}]):
        with pytest.raises(ValueError):
            elt.from_rows(spark, t, bad)
    assert elt.from_rows(spark, t, []).count() == 0


# Sinks


def test_save_modes_and_read_back(spark, tmp_path):
    m, root = parse_ddl("create table p (id int primary key); create table c (id int primary key, p_id int references p)"), f"file://{tmp_path}/w"
    data = {"p": frame(spark, "id int", (1,)), "c": frame(spark, "id int, p_id int", (1, 1), (2, 1))}
    with pytest.raises(FileNotFoundError):
        sinks.load(spark, m, root)
    sinks.save(spark, data, m, root)
    with pytest.raises(FileExistsError):
        sinks.save(spark, data, m, root)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "w" / "_data").rglob("*.parquet")}
    sinks.save(spark, data, m, root, sinks.APPEND)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "w" / "_data").rglob("*.parquet")}
    assert len(after) > len(before) and all(after[f] == n for f, n in before.items())  # nothing that was there is written again
    assert sinks.load(spark, m, root)["c"].count() == 4
    sinks.save(spark, data, m, root, sinks.RECREATE)
    broken = data | {"c": data["c"].withColumn("id", F.raise_error("no"))}
    with pytest.raises(Exception, match="no"):
        sinks.save(spark, broken, m, root, sinks.RECREATE)
    assert sinks.load(spark, m, root)["c"].count() == 2 and not list((tmp_path / "w" / "_changes").glob("*.json"))
    with pytest.raises(ValueError, match="others"):
        sinks.save(spark, {"p": data["p"].withColumn("x", F.lit(1))}, m, root, sinks.REUSE)


def test_names_of_targets():
    assert (sinks.slug("Ada's 1st Shop!"), sinks.slug("2 go"), sinks.slug(""), sinks.target_namespace("Ada", prefix="Dev x")) == ("ada_s_1st_shop", "uc_2_go", "use_case", "dev_x_ada")
    for name in ("public", "pg_x", "information_schema"):
        with pytest.raises(ValueError):
            sinks.target_namespace("x", explicit=name)


def test_workbook_and_report(spark, tmp_path):
    name = "a_table_with_a_very_long_name_indeed"
    m = parse_ddl(f"create table {name} (id int primary key, said text, n numeric(5,2)); create table {name}_2 (id int primary key)")
    data = {name: frame(spark, "id int, said string, n decimal(5,2)", (1, "=1+1", Decimal("1.50")), (2, "<&>", None)), f"{name}_2": frame(spark, "id int", (1,))}
    path = tmp_path / "x.xlsx"
    sinks.write_xlsx(data, m, str(path))
    with zipfile.ZipFile(path) as z:
        book, sheet = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert f'name="{name[:31]}"' in book and f'name="{name[:29]}_2"' in book and "'=1+1" in sheet and "&lt;&amp;&gt;" in sheet and "<v>1.5</v>" in sheet
    sinks.write_xlsx(data, m, str(path), sheet_rows=1)
    with zipfile.ZipFile(path) as z:  # two rows, two sheets; two summary rows, two sheets
        assert z.read("xl/workbook.xml").decode().count("<sheet ") == 5 and "xl/styles.xml" in z.namelist() and 's="1"' in z.read("xl/worksheets/sheet1.xml").decode()
    assert sinks.report("Checks", checks.validate(m, data), str(tmp_path / "r.md")) == "passed" and "| primary_key |" in (tmp_path / "r.md").read_text()


def test_sheets_of_many_parts_hold_all_rows(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as tree

    monkeypatch.setattr(sinks, "PART_ROWS", 7)
    m = parse_ddl("create table t (id int primary key, said text, v double precision)")
    rows = [(k, None if k % 5 == 0 else f"<{k}>é\x01", float("nan") if k == 3 else k / 4) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, said string, v double").repartition(3)
    sinks.write_xlsx({"t": df, "none": df}, m, str(tmp_path / "x.xlsx"), sheet_rows=20)
    got = []
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.testzip() is None
        for name in (n for n in z.namelist() if n.startswith("xl/worksheets/") and not n.endswith("sheet1.xml")):
            sheet = [[c[0][0].text if c.get("t") == "inlineStr" else c[0].text if len(c) else None for c in r] for r in tree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")]
            assert sheet[0] == ["id", "said", "v"] and len(sheet) <= 21
            got += sheet[1:]
    assert sorted((int(a), b, c) for a, b, c in got) == [(k, None if k % 5 == 0 else f"<{k}>é", "nan" if k == 3 else str(k / 4)) for k in range(100)]


def test_checksums_are_joined():
    import zlib

    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"some text", b"and some more" * 999), (bytes(70_000), b"x")):
        assert sinks._joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cells(spark):
    df = spark.sql("select '-1' a, timestamp '2024-01-01 10:00:00+02:00' b, X'0aff' c, array(2, 1) d, map('b', 1, 'a', 2) e, cast(null as string) f")
    r = sinks.safe_cells(df).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("'-1", dt.datetime(2024, 1, 1, 8), "0aff", "[2,1]", '{"a":2,"b":1}', None)
