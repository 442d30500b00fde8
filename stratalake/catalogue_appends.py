"""Registered queries of versions, appends, restarts and repeated runs, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalake import runs
from stratalake.catalogue import read
from stratalake.catalogue_flows import SHOP, SHOP_DDL, STATEMENTS, _raw
from stratalake.operators import checks, elt
from stratalake.plans import gate
from stratalake.plans.layers import plan_layers
from stratalake.scratch import shared_dir
from stratalake.sources import catalog, sinks
from stratalake.sources.ddl import parse_ddl
from stratalake.sources.ledger import Conflict, Ledger, Saved

PEOPLE = parse_ddl("CREATE TABLE dim_person (person_key bigint PRIMARY KEY, customer_id bigint UNIQUE, person_name text, segment text)")
BOOKS = parse_ddl("""
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text UNIQUE);
CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL REFERENCES customer, o_totalprice double precision);
""")
SPEC = {"load_table_rows": {}, **STATEMENTS, "assumptions": []}


def identity_appends(spark, sf):
    """Customers saved in two parts that overlap: the second goes on with the first one's numbers, and known customers keep theirs."""
    table, root = PEOPLE.table("dim_person"), shared_dir(spark, "appends")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("person_name"), F.col("c_mktsegment").alias("segment"))
    book = Ledger(spark, root)
    for part, mode in ((F.col("customer_id") % 10 < 6, sinks.FAIL), (F.col("customer_id") % 10 >= 4, sinks.APPEND)):
        rows = elt.fit_to_table(c.filter(part), table, "customer_id", Saved(book, book.current()))
        sinks.save(spark, {table.name: rows}, PEOPLE, root, mode)
    last = book.current().tables[table.name].marks["person_key"]
    return book.read(table.name).withColumn("last_key", F.lit(last).cast("long"))


def append_violations(spark, sf):
    """Orders and customers added to saved ones: repeated keys and orphans over old and new rows together."""
    root = shared_dir(spark, "appends")
    c, o = read(spark, sf, "customer").select("c_custkey", "c_name"), read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    sinks.save(spark, {"customer": c.filter("c_custkey % 3 = 0"), "orders": o.filter("o_custkey % 3 = 0 AND o_orderkey % 2 = 0")}, BOOKS, root)
    more = {"customer": c.filter("c_custkey % 3 = 1 OR c_custkey % 15 = 0"), "orders": o.filter("o_orderkey % 2 = 1 OR o_orderkey % 7 = 0")}
    stage = sinks.Stage(spark, more, BOOKS, root, sinks.APPEND)
    found = checks.validate(BOOKS, stage.tables(), saved=stage.saved).filter(F.col("check_id").isin("primary_key", "unique", "foreign_key"))
    return found.select("check_id", "table_name", "columns", "violations")


def versions_read(spark, sf):
    """Rows and sums of each version of orders: saved, added to, replaced; an older version is read as it was, and the second of two writers is refused."""
    model, root = parse_ddl("CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_totalprice double precision)"), shared_dir(spark, "versions")
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    part = lambda k: {"orders": o.filter(F.col("o_orderkey") % 3 == k)}
    sinks.save(spark, part(0), model, root)
    late, first = (sinks.Stage(spark, part(k), model, root, sinks.APPEND) for k in (2, 1))
    first.swap()
    try:
        late.swap()
        refused = False
    except Conflict:
        refused = True
    sinks.save(spark, part(2), model, root, sinks.RECREATE)
    book = Ledger(spark, root)
    said = [book.read("orders", book.version(n)).select(F.lit(n).cast("long").alias("version"), "o_orderkey", "o_totalprice") for n in (1, 2, 3)]
    every = said[0].unionAll(said[1]).unionAll(said[2])
    return every.groupBy("version").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last_order"), F.lit(refused).alias("late_writer_refused"))


class _Died(Exception):
    pass


def run_with_restart(spark, sf):
    """A run that dies after its dimensions and goes on: the facts, from layers that were written once."""
    root, raw = shared_dir(spark, "restart"), _raw(spark, sf)
    write, wrote = sinks.Stage.write, []

    def dying(self, name, rows, of=""):
        if name == "fact_order" and "died" not in wrote:
            wrote.append("died")
            raise _Died
        wrote.append(name)
        return write(self, name, rows, of)

    sinks.Stage.write = dying
    try:
        for _ in range(2):
            try:
                done = runs.run_elt(spark, SHOP_DDL, SPEC, root=root, raw=raw)
            except _Died:
                continue
    finally:
        sinks.Stage.write = write
    facts = sinks.load(spark, SHOP, root)["fact_order"].withColumn("amount", F.col("amount").cast("double"))
    return facts.withColumn("status", F.lit(done.status)).withColumn("tables_written", F.lit(len(wrote) - 1).cast("long"))


def repeated_runs(spark, sf):
    """Three runs into one target: all is written, then nothing, then what follows from one changed input."""
    root, raw, rows = shared_dir(spark, "repeated"), _raw(spark, sf), []
    for k, given in enumerate((raw, raw, raw | {"load_order_raw": raw["load_order_raw"].filter("load_id % 2 = 0")}), 1):
        before = Ledger(spark, root).current().tables
        runs.run_elt(spark, SHOP_DDL, SPEC, root=root, mode=sinks.RECREATE, raw=given)
        after = Ledger(spark, root).current().tables
        counts = checks.row_counts(sinks.load(spark, SHOP, root)).collect()  # one row a table
        rows += [(k, r["table_name"], r["row_count"], r["table_name"] not in before or before[r["table_name"]].folders != after[r["table_name"]].folders) for r in counts]
    return spark.createDataFrame(rows, "run long, table_name string, row_count long, written boolean")


LINES_DDL = """
CREATE TABLE load_sale_raw (load_id bigint PRIMARY KEY, source_payload jsonb NOT NULL);
CREATE TABLE stg_sale_line (sale_id bigint, line_number integer, part_id bigint, quantity numeric(12,2), PRIMARY KEY (sale_id, line_number, part_id));
"""
LINES = {"staging_sql": ["""
INSERT INTO stg_sale_line (sale_id, line_number, part_id, quantity) SELECT r.load_id, l.line_number, l.part_id, l.quantity FROM load_sale_raw r,
LATERAL inline(from_json(get_json_object(r.source_payload, '$.lines'), 'array<struct<line_number: int, part_id: bigint, quantity: decimal(12,2)>>')) AS l (line_number, part_id, quantity)
"""], "dimension_sql": [], "fact_sql": []}  # fmt: skip


def lateral_lines(spark, sf):
    """Orders as documents with their lines inside, taken apart by an admitted statement with LATERAL."""
    model = parse_ddl(LINES_DDL)
    l = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    raw = o.select(F.col("o_orderkey").alias("load_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "lines")).alias("source_payload"))
    made = gate.execute(spark, LINES, model, plan_layers(model), {"load_sale_raw": raw})
    return made["stg_sale_line"].withColumn("quantity", F.col("quantity").cast("double"))


def index_scan(spark, sf):
    """Line items saved under an index on their ship date: those of one year, from the data files that may hold it."""
    model, root = parse_ddl("CREATE TABLE line (order_id bigint, line_number integer, ship_date date, price double precision, PRIMARY KEY (order_id, line_number)); CREATE INDEX ix_line_ship ON line USING btree (ship_date DESC)"), shared_dir(spark, "index")
    l = read(spark, sf, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("int").alias("line_number"), F.to_date("l_shipdate").alias("ship_date"), F.col("l_extendedprice").alias("price"))
    book = Ledger(spark, root, file_rows=max(1, rows.count() // 40))
    change = book.begin()
    change.write(rows, model.table("line"))
    change.commit()
    found, opened, files = book.scan("line", "ship_date", "1997-01-01", "1997-12-31")
    return found.groupBy("ship_date").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("price"), 2).alias("price")).withColumn("skips_most_files", F.lit(0 < opened <= files / 3))


BUCKETED = parse_ddl("""
CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint);
CREATE TABLE lineitem (l_orderkey bigint REFERENCES orders, l_linenumber integer, l_quantity double precision, PRIMARY KEY (l_orderkey, l_linenumber));
""")


def bucketed_orphans(spark, sf):
    """Lines without an order, of tables bucketed along their foreign key: their number and the shuffles of the join, of which there are none."""
    name = f"stratalake_{uuid.uuid4().hex[:12]}"
    rows = {"orders": read(spark, sf, "orders").filter("o_orderkey % 10 <> 3"), "lineitem": read(spark, sf, "lineitem")}
    data = {t.name: rows[t.name].select(*(F.col(c.name).cast(c.spark_type).alias(c.name) for c in t.columns)) for t in BUCKETED.tables}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        catalog.publish(spark, data, BUCKETED, name, buckets=8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        there = catalog.read_back(spark, BUCKETED, name)
        fk = BUCKETED.table("lineitem").foreign_keys[0]
        gone = checks.orphans(there["lineitem"], fk.columns, there["orders"], fk.parent_columns)
        shuffles = gone._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        found = gone.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        catalog.drop(spark, name)
    return spark.createDataFrame([(found["n"], found["quantity"], shuffles)], "orphans long, quantity double, shuffles long")


QUERIES = {f.__name__: f for f in (identity_appends, append_violations, versions_read, run_with_restart, repeated_runs, lateral_lines, index_scan, bucketed_orphans)}
_COUNTS = """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(12,2) AS amount, o_orderkey % 2 = 0 AS even FROM orders),
  c AS (SELECT count(*) AS all_rows, count(*) FILTER (even) AS even_rows, count(*) FILTER (amount >= 1000) AS large, count(*) FILTER (amount >= 1000 AND even) AS large_even FROM o JOIN customer ON c_custkey = o_custkey), n AS (SELECT count(*) AS n FROM customer)"""
SQL = {
    "index_scan": "SELECT l_shipdate::DATE AS ship_date, count(*) AS lines, round(sum(l_extendedprice), 2) AS price, true AS skips_most_files FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1",
    "bucketed_orphans": "SELECT count(*) AS orphans, sum(l_quantity)::DOUBLE AS quantity, 0::BIGINT AS shuffles FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)",
    "lateral_lines": "SELECT l_orderkey AS sale_id, l_linenumber::INTEGER AS line_number, l_partkey AS part_id, l_quantity::DECIMAL(12,2)::DOUBLE AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "identity_appends": """
WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 10 < 6),
  b AS (SELECT c_custkey, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 10 >= 6)
SELECT k AS person_key, c_custkey AS customer_id, c_name AS person_name, c_mktsegment AS segment, (SELECT count(*) FROM customer) AS last_key
FROM customer JOIN (FROM a UNION ALL FROM b) USING (c_custkey)""",
    "append_violations": """
WITH old_c AS (SELECT * FROM customer WHERE c_custkey % 3 = 0), new_c AS (SELECT * FROM customer WHERE c_custkey % 3 = 1 OR c_custkey % 15 = 0),
  old_o AS (SELECT * FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0), new_o AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 7 = 0)
SELECT 'primary_key' AS check_id, 'customer' AS table_name, 'c_custkey' AS columns, count(*) AS violations FROM new_c WHERE c_custkey IN (SELECT c_custkey FROM old_c)
UNION ALL SELECT 'unique', 'customer', 'c_name', count(*) FROM new_c WHERE c_name IN (SELECT c_name FROM old_c)
UNION ALL SELECT 'primary_key', 'orders', 'o_orderkey', count(*) FROM new_o WHERE o_orderkey IN (SELECT o_orderkey FROM old_o)
UNION ALL SELECT 'foreign_key', 'orders', 'o_custkey -> customer(c_custkey)', count(*) FROM new_o WHERE o_custkey NOT IN (SELECT c_custkey FROM old_c UNION SELECT c_custkey FROM new_c)""",
    "versions_read": """
WITH v AS (SELECT 1::BIGINT AS version, * FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, * FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT 3, * FROM orders WHERE o_orderkey % 3 = 2)
SELECT version, count(*) AS row_count, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_order, true AS late_writer_refused FROM v GROUP BY version""",
    "run_with_restart": """
WITH d AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer), large AS (SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(12,2) AS amount FROM orders WHERE o_totalprice::DECIMAL(12,2) >= 1000)
SELECT row_number() OVER (ORDER BY o_orderkey) AS order_key, customer_key, o_orderkey AS order_id, amount::DOUBLE AS amount, 'passed_with_warnings' AS status, 6::BIGINT AS tables_written FROM large JOIN d ON o_custkey = c_custkey""",
    "repeated_runs": f"""{_COUNTS}
SELECT run, table_name, CASE table_name WHEN 'fact_order' THEN CASE run WHEN 3 THEN large_even ELSE large END WHEN 'dim_customer' THEN n WHEN 'stg_customer' THEN n WHEN 'load_customer_raw' THEN n
  ELSE CASE run WHEN 3 THEN even_rows ELSE all_rows END END AS row_count, run = 1 OR (run = 3 AND table_name IN ('load_order_raw', 'stg_order', 'fact_order')) AS written
FROM c, n, range(1, 4) r(run), (SELECT unnest(['load_customer_raw', 'load_order_raw', 'stg_customer', 'stg_order', 'dim_customer', 'fact_order']) AS table_name)""",
}
