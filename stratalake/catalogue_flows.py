"""Registered queries of whole flows and functions over the driver's tables: statements, views, defaults, saves, coercion, payload references."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.catalogue import read
from stratalake.functions import columns as fn
from stratalake.operators import checks, elt
from stratalake.operators.generate import generate
from stratalake.plans import gate
from stratalake.plans.layers import plan_layers
from stratalake.plans.profile import build_profile, payload_columns
from stratalake.scratch import shared_dir
from stratalake.sources import sinks
from stratalake.sources.ddl import extract_views, parse_ddl

SHOP_DDL = """
CREATE TABLE load_customer_raw (load_id bigint PRIMARY KEY, source_payload jsonb NOT NULL);
CREATE TABLE load_order_raw (LIKE load_customer_raw INCLUDING ALL);
CREATE TABLE stg_customer (customer_id bigint PRIMARY KEY, customer_name text NOT NULL, segment text);
CREATE TABLE stg_order (order_id bigint PRIMARY KEY, customer_id bigint NOT NULL REFERENCES stg_customer, amount numeric(12,2));
CREATE TABLE dim_customer (customer_key bigint PRIMARY KEY, customer_id bigint UNIQUE, customer_name text, segment text);
CREATE TABLE fact_order (order_key bigint PRIMARY KEY, customer_key bigint REFERENCES dim_customer, order_id bigint, amount numeric(12,2));
"""
SHOP = parse_ddl(SHOP_DDL)
STATEMENTS = {
    "staging_sql": [
        "INSERT INTO stg_customer (customer_id, customer_name, segment) SELECT p.customer_id, p.customer_name, p.segment FROM (SELECT from_json(source_payload, 'customer_id bigint, customer_name string, segment string') AS p FROM load_customer_raw)",
        "-- INSERT INTO old\nINSERT INTO stg_order (order_id, customer_id, amount) SELECT p.order_id, p.customer_id, p.amount FROM (SELECT from_json(source_payload, 'order_id bigint, customer_id bigint, amount decimal(12,2)') AS p FROM load_order_raw)",
    ],
    "dimension_sql": ["INSERT INTO dim_customer (customer_id, customer_name, segment) SELECT customer_id, customer_name, segment FROM stg_customer"],
    "fact_sql": ["WITH large AS (SELECT * FROM stg_order WHERE amount >= 1000) INSERT INTO fact_order (order_id, customer_key, amount) SELECT l.order_id, d.customer_key, l.amount FROM large l JOIN dim_customer d ON d.customer_id = l.customer_id"],
}
VIEWS = """```sql
CREATE VIEW vw_segment_orders AS SELECT c.c_mktsegment AS segment, COUNT(*) AS orders, SUM(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END)::numeric / NULLIF(COUNT(*), 0) AS finished
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment;
CREATE OR REPLACE VIEW vw_busiest AS SELECT segment, orders FROM vw_segment_orders WHERE orders >= (SELECT AVG(orders) FROM vw_segment_orders);
```"""


def _raw(spark, sf):
    """Raw tables of customers and orders as JSON records."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    wrap = lambda rows, key: elt.to_raw(rows, "driver").select(F.get_json_object("source_payload", f"$.{key}").cast("long").alias("load_id"), "source_payload")
    return {"load_customer_raw": wrap(c, "customer_id"), "load_order_raw": wrap(o, "order_id")}


def elt_statements(spark, sf):
    """Admitted statements over raw records: CTE, comment, columns in another order, keys numbered by the table."""
    made = gate.execute(spark, STATEMENTS, SHOP, plan_layers(SHOP), _raw(spark, sf))
    return made["fact_order"].withColumn("amount", F.col("amount").cast("double"))


def ddl_views(spark, sf):
    from stratalake.catalogue import MODEL

    made = gate.make_views(spark, extract_views(VIEWS), MODEL, {t: read(spark, sf, t) for t in ("orders", "customer")})
    busy = made["vw_busiest"].select("segment", F.lit(True).alias("busy"))
    return made["vw_segment_orders"].join(busy, "segment", "left").select("segment", "orders", F.round(F.col("finished").cast("double"), 6).alias("finished"), F.coalesce("busy", F.lit(False)).alias("busy"))


def payload_reference_check(spark, sf):
    """Keys of order records in customer records, of which a fifth is missing; parents are reused."""
    raw = _raw(spark, sf)
    profile = build_profile(SHOP, plan_layers(SHOP), 10)
    data = raw | {"load_customer_raw": raw["load_customer_raw"].filter("load_id % 5 <> 0")}
    return checks.payload_references(profile, data).select("check_id", "table_name", "columns", "violations")


def payload_distinct_keys(spark, sf):
    """Distinct against all keys of raw records, and keys that several records share."""
    return checks.payload_keys(_raw(spark, sf)["load_order_raw"], "customer_id")


def insert_with_defaults(spark, sf):
    """Rows fitted to a table: casts, defaults, a key that is numbered."""
    t = parse_ddl("CREATE TABLE dim_nation (nation_key bigint PRIMARY KEY, name varchar(25) NOT NULL, region integer, source text NOT NULL DEFAULT 'driver', active boolean DEFAULT true, weight numeric(6,2) DEFAULT 1.5, note text)").tables[0]
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return elt.fit_to_table(rows, t, "name").withColumn("weight", F.col("weight").cast("double"))


def save_and_append(spark, sf):
    """Two tables saved, added to and read back; the counts of each step."""
    model = parse_ddl("CREATE TABLE region (r_regionkey integer PRIMARY KEY, r_name text); CREATE TABLE nation (n_nationkey integer PRIMARY KEY, n_name text, n_regionkey integer REFERENCES region)")
    data = {t.name: read(spark, sf, t.name).select(*t.column_names) for t in model.tables}
    root = shared_dir(spark, "warehouse")
    sinks.save(spark, data, model, root)
    first = checks.row_counts(sinks.load(spark, model, root)).collect()
    sinks.save(spark, data, model, root, sinks.APPEND)
    then = checks.row_counts(sinks.load(spark, model, root)).select(F.lit("appended").alias("step"), "table_name", "row_count")
    return spark.createDataFrame([("saved", r["table_name"], r["row_count"]) for r in first], "step string, table_name string, row_count long").unionAll(then)


def warehouse_summary(spark, sf):
    raw = _raw(spark, sf)
    return spark.createDataFrame(sinks.summary(raw, SHOP), "layer string, table_name string, row_count long, column_count long, purpose string, keys string").drop("purpose")


def coerce_values(spark, sf):
    """Text as types, with the fallback of the type where it can't be one; decimals are rounded half to even."""
    t = parse_ddl("CREATE TABLE x (whole integer, amount numeric(8,2), flag boolean, day date, said varchar(4), order_date_key integer)").tables[0]
    l = elt.spread(read(spark, sf, "lineitem"))
    text = F.when(F.col("l_linenumber") == 7, F.lit("none")).otherwise((F.col("l_linenumber") * 0.125).cast("string"))
    rows = l.select(
        "l_orderkey", "l_linenumber", text.alias("t"), F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "N", "0").alias("f"),
        F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("soon").alias("d"), F.concat(F.lit("ab"), F.col("l_orderkey").cast("string")).alias("s"),
    )
    as_column = lambda c, name: fn.coerce(F.col(c), t.column(name)).alias(name)
    return rows.select("l_orderkey", "l_linenumber", as_column("t", "whole"), as_column("t", "amount").cast("double").alias("amount"), as_column("f", "flag"), as_column("d", "day"), as_column("s", "said"), as_column("d", "order_date_key"))


def person_cells(spark, sf):
    """E-mail within a length, text within a length, a name-based UUID."""
    c = read(spark, sf, "customer")
    i = F.col("c_custkey")
    return c.select(
        "c_custkey", fn.email(F.col("c_mktsegment"), F.lit("O'Neil"), i).alias("email"), fn.email(F.col("c_mktsegment"), F.lit("x"), i, 24).alias("short_email"), fn.bounded(F.col("c_name"), 12).alias("name"),
        fn.uuid5(F.concat(F.lit("customer.code."), i.cast("string"))).alias("code"),
    )


def bounded_draws(spark, sf):
    """Numbers that depend on their parts alone: in bounds, the same in any order, and all values occur."""
    rows = read(spark, sf, "orders").select("o_orderkey", fn.draw(3, 12, 42, "orders", F.col("o_orderkey")).alias("n"))
    again = rows.repartition(7, "n").select("o_orderkey", fn.draw(3, 12, 42, "orders", F.col("o_orderkey")).alias("m"))
    both = rows.join(again, "o_orderkey").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("n").between(3, 12)).alias("out_of_bounds"), F.count_if(F.col("n") != F.col("m")).alias("changed"), F.count_distinct("n").alias("distinct_values"))
    return both


def generated_warehouse(spark, sf):
    """A generated warehouse of four layers, an order for each customer of the given table: violations of its model, lineage and payload alignment by kind of check."""
    model, plan, n = SHOP, plan_layers(SHOP), read(spark, sf, "customer").count()
    data = generate(spark, model, n, 7, None, plan)
    profile = build_profile(model, plan, n)
    parts = [checks.validate(model, data, profile.rows), checks.validate_lineage(model, data, plan), checks.payload_references(profile, data)]
    parts += [checks.payload_checks(t, data[t], r.required) for t, r in profile.raw.items()]
    found = checks.union(parts, spark).filter(F.col("severity") != "info")
    return found.groupBy("check_id").agg(F.count(F.lit(1)).alias("checks"), F.sum("violations").alias("violations"))


def raw_staging_alignment(spark, sf):
    """Generated raw payloads hold what staging holds: rows of each pair, and rows that differ in any column."""
    model, plan = SHOP, plan_layers(SHOP)
    data = generate(spark, model, read(spark, sf, "customer").count(), 7, None, plan)
    parts = []
    for s in plan.of("staging"):
        raw, t = plan.sources(s, "raw_load")[0], model.table(s)
        shape = ", ".join(f"{c.name} {c.spark_type.simpleString()}" for c in t.columns if c.name in payload_columns(t))
        sent = elt.to_staging(data[raw], shape)
        lost = data[s].select(*sent.columns).exceptAll(sent)
        parts.append(lost.agg(F.count(F.lit(1)).alias("different")).crossJoin(data[s].agg(F.count(F.lit(1)).alias("row_count"))).select(F.lit(s).alias("table_name"), "row_count", "different"))
    return parts[0].unionAll(parts[1])


PEOPLE_DDL = """
CREATE TABLE load_member_raw (load_id bigint PRIMARY KEY, source_payload jsonb NOT NULL);
CREATE TABLE stg_member (member_id text PRIMARY KEY, first_name text NOT NULL, last_name text NOT NULL, email text NOT NULL, birth_date date, start_date date, end_date date, code uuid, status text CHECK (status IN ('New', 'Old')), quantity integer, unit_price numeric(8,2), line_total numeric(12,2));
CREATE TABLE dim_member (member_key bigint PRIMARY KEY, member_id text UNIQUE, first_name text, last_name text, email text);
"""


def generated_people(spark, sf):
    """Generated rows that must agree with each other: mail and name, start and end, price and total, a staging table and its dimension, twice the same seed."""
    model, n = parse_ddl(PEOPLE_DDL), read(spark, sf, "supplier").count()
    data, again = (generate(spark, model, n, 11, {"reference_data": {"unused": ["x"]}}, plan_layers(model)) for _ in range(2))
    m, dim = data["stg_member"], data["dim_member"]
    mail = F.lower(F.concat_ws(".", "first_name", "last_name"))
    seen = m.agg(
        F.count(F.lit(1)).alias("people"), F.count_if(~F.col("email").startswith(mail)).alias("other_mail"), F.count_if(F.col("end_date") < F.col("start_date")).alias("ends_early"),
        F.count_if(~F.year("birth_date").between(1970, 2004)).alias("odd_birth"), F.count_if(F.col("line_total") != F.col("quantity") * F.col("unit_price")).alias("odd_total"),
        F.count_distinct("code").alias("codes"), F.count_if(~F.col("status").isin("New", "Old")).alias("odd_status"),
    )
    shared = ["member_id", "first_name", "last_name", "email"]
    apart = dim.select(shared).exceptAll(m.select(shared)).agg(F.count(F.lit(1)).alias("dimension_differs"))
    changed = m.exceptAll(again["stg_member"]).agg(F.count(F.lit(1)).alias("changed"))
    return seen.crossJoin(apart).crossJoin(changed)  # one row each


def sampled_violations(spark, sf):
    """The first violation of a check, by primary key, comes with its count."""
    from stratalake.catalogue import MODEL

    got = checks.row_checks(MODEL.table("customer"), read(spark, sf, "customer"), kinds={"check"})
    return got.select("table_name", "columns", "violations", "sample")


QUERIES = {
    f.__name__: f
    for f in (
        elt_statements, ddl_views, payload_reference_check, payload_distinct_keys, insert_with_defaults, save_and_append, warehouse_summary, coerce_values, person_cells,
        bounded_draws, generated_warehouse, raw_staging_alignment, generated_people, sampled_violations,
    )
}
SQL = {
    "elt_statements": """
WITH d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer), large AS (SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(12,2) AS amount FROM orders WHERE o_totalprice::DECIMAL(12,2) >= 1000)
SELECT row_number() OVER (ORDER BY o_orderkey) AS order_key, customer_key, o_orderkey AS order_id, amount::DOUBLE AS amount FROM large JOIN d ON o_custkey = c_custkey""",
    "ddl_views": """
WITH v AS (SELECT c_mktsegment AS segment, count(*) AS orders, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS finished FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT segment, orders, finished, orders >= (SELECT avg(orders) FROM v) AS busy FROM v""",
    "payload_reference_check": """
SELECT 'payload_reference' AS check_id, 'load_order_raw' AS table_name, 'customer_id -> load_customer_raw' AS columns, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)) AS violations FROM orders
UNION ALL SELECT 'payload_reuse', 'load_order_raw', 'customer_id -> load_customer_raw', CASE WHEN max(n) < 2 THEN 1 ELSE 0 END FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
    "payload_distinct_keys": "SELECT sum(n)::BIGINT AS records, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS reused_keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "insert_with_defaults": "SELECT row_number() OVER (ORDER BY n_name) AS nation_key, n_name AS name, n_regionkey::INTEGER AS region, 'driver' AS source, true AS active, 1.5::DOUBLE AS weight, NULL::VARCHAR AS note FROM nation",
    "save_and_append": """
WITH c AS (SELECT 'region' AS table_name, count(*) AS row_count FROM region UNION ALL SELECT 'nation', count(*) FROM nation)
SELECT 'saved' AS step, table_name, row_count FROM c UNION ALL SELECT 'appended', table_name, 2 * row_count FROM c""",
    "warehouse_summary": """
SELECT 'raw_load' AS layer, 'load_customer_raw' AS table_name, count(*) AS row_count, 2::BIGINT AS column_count, 'load_id' AS keys FROM customer
UNION ALL SELECT 'raw_load', 'load_order_raw', count(*), 2, 'load_id' FROM orders""",
    "coerce_values": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END::INTEGER AS whole,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE round_even(l_linenumber * 0.125::DOUBLE, 2) END::DOUBLE AS amount, CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'N' THEN false END AS flag,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE ELSE DATE '2026-07-06' END AS day, substr('ab' || l_orderkey::VARCHAR, 1, 4) AS said, 20260706 AS order_date_key FROM lineitem""",
    "person_cells": """
WITH c AS (SELECT c_custkey, c_name, lower(c_mktsegment) AS s, regexp_replace(lower(concat(c_mktsegment, '.o''neil.', format('{:03d}', c_custkey))), '[^a-z0-9.]', '', 'g') || '@example.com' AS email,
  regexp_replace(lower(concat(c_mktsegment, '.x.', format('{:03d}', c_custkey))), '[^a-z0-9.]', '', 'g') || '@example.com' AS long, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('customer.code.' || c_custkey::VARCHAR)) AS h FROM customer)
SELECT c_custkey, email, substr(CASE WHEN length(long) > 24 THEN 'u' || c_custkey || '@x.co' ELSE long END, 1, 24) AS short_email, substr(c_name, 1, 12) AS name,
  concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS code FROM c""",
    "bounded_draws": "SELECT count(*) AS row_count, 0::BIGINT AS out_of_bounds, 0::BIGINT AS changed, 10::BIGINT AS distinct_values FROM orders",
    "sampled_violations": """
WITH bad AS (SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'))
SELECT 'customer' AS table_name, 'c_mktsegment' AS columns, count(*) AS violations, min(c_custkey)::VARCHAR || ': ' || arg_min(c_mktsegment, c_custkey) AS sample FROM bad""",
    # Two foreign-key-like columns of the fact aren't declared; nothing else is amiss.
    "generated_warehouse": """
SELECT check_id, checks::BIGINT AS checks, violations::BIGINT AS violations FROM (VALUES ('required', 10, 0), ('placeholder', 6, 0), ('row_count', 6, 0), ('primary_key', 6, 0), ('semantic_placeholder', 2, 0), ('digits', 2, 0), ('foreign_key', 2, 0), ('unique', 1, 0),
  ('undeclared_key', 2, 2), ('staging_in_raw', 1, 0), ('dimension_in_staging', 1, 0), ('fact_in_dimension', 1, 0), ('payload_reference', 1, 0), ('payload_reuse', 1, 0), ('payload_key', 4, 0), ('payload_object', 2, 0)) t (check_id, checks, violations)""",
    "raw_staging_alignment": "SELECT 'stg_customer' AS table_name, ceil(count(*) * 0.45)::BIGINT AS row_count, 0::BIGINT AS different FROM customer UNION ALL SELECT 'stg_order', count(*), 0 FROM customer",
    # A table of members holds parts of an event, three for each base row.
    "generated_people": """
SELECT 3 * count(*) AS people, 0::BIGINT AS other_mail, 0::BIGINT AS ends_early, 0::BIGINT AS odd_birth, 0::BIGINT AS odd_total, 3 * count(*) AS codes, 0::BIGINT AS odd_status,
  0::BIGINT AS dimension_differs, 0::BIGINT AS changed FROM supplier""",
}
