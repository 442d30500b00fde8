"""Registered queries of the warehouse operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.functions import columns as fn
from stratalake.operators import checks, derive, elt, views
from stratalake.operators.generate import table_rows
from stratalake.plans.semantics import meanings
from stratalake.sources.ddl import parse_ddl
from stratalake.sources.sinks import safe_cells

#: The driver's tables as a schema text; the checks are ours, some of them violated.
DDL = """
CREATE TABLE region (r_regionkey integer PRIMARY KEY, r_name varchar(25) NOT NULL UNIQUE);
CREATE TABLE nation (n_nationkey integer PRIMARY KEY, n_name varchar(25) NOT NULL, n_regionkey integer NOT NULL REFERENCES region);
CREATE TABLE customer (
  c_custkey bigint PRIMARY KEY, c_name varchar(18) NOT NULL, c_nationkey integer NOT NULL REFERENCES nation (n_nationkey),
  c_acctbal numeric(6,2), c_mktsegment varchar(10) CHECK (c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')));
CREATE TABLE supplier (s_suppkey bigint PRIMARY KEY, s_name varchar(18) NOT NULL, s_nationkey integer REFERENCES nation, s_acctbal numeric(6,2) CHECK (s_acctbal >= 0));
CREATE TABLE part (
  p_partkey bigint PRIMARY KEY, p_name varchar(12) NOT NULL, p_brand varchar(10), p_type varchar(25), p_size integer CHECK (p_size BETWEEN 5 AND 45),
  p_retailprice numeric(6,2));
CREATE TABLE orders (
  o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL REFERENCES customer, o_orderstatus varchar(1) CHECK (o_orderstatus = ANY (ARRAY['F', 'O'])),
  o_totalprice numeric(7,2), o_orderdate timestamp NOT NULL, o_orderpriority varchar(15));
CREATE TABLE lineitem (
  l_orderkey bigint REFERENCES orders, l_partkey bigint REFERENCES part, l_suppkey bigint REFERENCES supplier, l_linenumber integer,
  l_quantity numeric(4,1) CHECK (l_quantity < 40), l_extendedprice numeric(7,2), l_discount numeric(4,2), l_tax numeric(4,2), l_returnflag char(1),
  l_linestatus char(1), l_shipdate timestamp, PRIMARY KEY (l_orderkey, l_linenumber));
CREATE TABLE events (event_id bigint PRIMARY KEY, ts timestamp, user_id bigint REFERENCES customer (c_custkey), event_type varchar(20), value double precision, props jsonb, UNIQUE (user_id, event_type));
"""
MODEL = parse_ddl(DDL)
STAR = "region nation customer supplier part orders lineitem events".split()

#: A small layered schema, for plans and profiles.
LAYERED_DDL = """
CREATE TABLE load_customer_raw (load_id bigint PRIMARY KEY, source_payload jsonb NOT NULL, loaded_at timestamptz DEFAULT now());
CREATE TABLE load_order_raw (LIKE load_customer_raw INCLUDING ALL);
CREATE TABLE load_order_item_raw (LIKE load_customer_raw INCLUDING ALL);
CREATE TABLE stg_customer (customer_id varchar(20) PRIMARY KEY, customer_name varchar(50) NOT NULL, staged_at timestamptz DEFAULT now());
CREATE TABLE stg_order (order_id varchar(30) PRIMARY KEY, customer_id varchar(20) NOT NULL REFERENCES stg_customer, order_date date NOT NULL);
CREATE TABLE stg_order_item (order_item_id varchar(30) PRIMARY KEY, order_id varchar(30) NOT NULL REFERENCES stg_order, quantity integer NOT NULL);
CREATE TABLE dim_customer (customer_key bigint PRIMARY KEY, customer_id varchar(20) UNIQUE, customer_name varchar(50));
CREATE TABLE fact_order (order_key bigint PRIMARY KEY, customer_key bigint REFERENCES dim_customer, order_id varchar(30));
CREATE TABLE fact_order_item (order_item_key bigint PRIMARY KEY, customer_key bigint REFERENCES dim_customer, order_item_id varchar(30), quantity integer);
"""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def star(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: read(spark, sf, t) for t in STAR}


# Layers


def project_customer(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"))


ITEM_SCHEMA = "order_id long, part_id long, supplier_id long, line_number int, quantity decimal(14,2), extended_price decimal(14,2), discount decimal(14,2), tax decimal(14,2), return_flag string, line_status string, ship_date date"


def raw_items(spark, sf, keep=None):
    l = elt.spread(read(spark, sf, "lineitem"))
    rows = (l.filter(keep) if keep is not None else l).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast("decimal(14,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("extended_price"),
        F.col("l_discount").cast("decimal(14,2)").alias("discount"), F.col("l_tax").cast("decimal(14,2)").alias("tax"), F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"), F.to_date("l_shipdate").alias("ship_date"),
    )
    return elt.to_raw(rows, "lineitem")


def staged_items(spark, sf, keep=None):
    """Lines from their raw records; ``keep``, a condition on the lines, is asked before records are made of them."""
    return elt.to_staging(raw_items(spark, sf, keep), ITEM_SCHEMA)


def stg_order_item_from_raw(spark, sf):
    money = ("quantity", "extended_price", "discount", "tax")
    return staged_items(spark, sf).withColumns({c: F.col(c).cast("double") for c in money})


def stg_event_props(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", "event_type", fn.json_field(F.col("props"), "k", "bigint").alias("k"), fn.is_json_object(F.col("props")).alias("is_object"))


def payload_required_keys(spark, sf):
    items = checks.payload_checks("lineitem", raw_items(spark, sf), ["order_id", "part_id", "coupon"])
    return items.unionAll(checks.payload_checks("events", read(spark, sf, "events"), ["k"], "props")).select("check_id", "table_name", "columns", "violations")


def dates(spark, sf):
    return elt.calendar(read(spark, sf, "orders").select("o_orderdate"), read(spark, sf, "lineitem").select("l_shipdate"))


def dim_date_calendar(spark, sf):
    return dates(spark, sf)


def customer_rows(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return wide.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def dim_customer(spark, sf):
    return elt.dimension(customer_rows(spark, sf), "customer_key", "customer_id", "customer_name", "segment", "nation", "region")


def dim_customer_surrogate(spark, sf):
    return dim_customer(spark, sf)


def product_rows(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").cast("long").alias("size"))


def dim_product(spark, sf):
    return elt.dimension(product_rows(spark, sf), "product_key", "product_id", "product_name", "brand", "category", "size")


def order_rows(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(14,2)").alias("total_price"),
    )


def dim_order(spark, sf, customers=None):
    joined = elt.look_up(order_rows(spark, sf), customers if customers is not None else dim_customer(spark, sf), "customer_id", "customer_key")
    return elt.dimension(joined, "order_key", "order_id", "customer_key", "order_date", "status", "priority", "total_price")


def dim_order_surrogate(spark, sf):
    return dim_order(spark, sf).select("order_key", "order_id", "customer_key", "order_date", "status", "priority")


def _amounts(lines):
    """Lines with gross, discount and net amount; net = price less discount."""
    off = F.round(F.col("extended_price") * F.col("discount"), 2).cast("decimal(14,2)")
    return lines.withColumns({"gross_amount": F.col("extended_price"), "discount_amount": off, "net_amount": (F.col("extended_price") - off).cast("decimal(14,2)")})


def sale_lines(spark, sf, keep=None):
    """Lines with their amounts, by the ids they came with: for what looks at no other table."""
    return _amounts(staged_items(spark, sf, keep).withColumnRenamed("part_id", "product_id"))


def order_days(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))


def sales(spark, sf, orders=None, products=None, keep=None):
    """The fact at line grain.

    ``orders``, ``products``: the dimensions whose keys (of order and customer, of product) are looked up.
    """
    dim = orders.select("order_id", "order_key", "customer_key", "order_date") if orders is not None else order_days(spark, sf)
    lines = sale_lines(spark, sf, keep).join(dim, "order_id")
    if products is not None:
        lines = elt.look_up(lines, products, "product_id", "product_key")
    lines = elt.look_up_date(lines, dates(spark, sf), "order_date", "order_date_key")
    return lines.select(
        "order_id", "line_number", *(["order_key", "customer_key"] if orders is not None else []), *(["product_key"] if products is not None else []), "order_date_key", "quantity",
        "gross_amount", "discount_amount", "net_amount", "return_flag", "line_status", "order_date", "ship_date",
    )


def fact_sales(spark, sf):
    money = ("quantity", "gross_amount", "discount_amount", "net_amount")
    lines = sales(spark, sf, dim_order(spark, sf), dim_product(spark, sf))
    return lines.select("order_id", "line_number", "order_key", "customer_key", "product_key", "order_date_key", *(F.col(c).cast("double").alias(c) for c in money))


def delivered_lines(spark, sf):
    """Lines with the days they were ordered, shipped and received, which open lines aren't yet, and how late that was."""
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    lines = l.join(o.select("o_orderkey", "o_orderdate"), l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_linestatus").alias("line_status"), F.to_date("o_orderdate").alias("ordered"),
        F.to_date("l_shipdate").alias("shipped"), F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("received"),
    )
    delay = F.datediff("received", "ordered").cast("long")
    return lines.withColumns({
        "delivery_delay_days": delay, "delivered_count": F.when(F.col("received").isNotNull(), 1).otherwise(0), "delayed_count": F.when(delay > 60, 1).otherwise(0),
    })


def deliveries(spark, sf):
    """Roles of the date dimension: ordered, shipped, received."""
    lines, d = delivered_lines(spark, sf), dates(spark, sf)
    lines = elt.look_up_date(lines, d, "ordered", "order_date_key")
    lines = elt.look_up_date(lines, d, "shipped", "ship_date_key")
    lines = elt.look_up_date(lines, d, "received", "received_date_key", "left")
    return lines.select("order_id", "line_number", "line_status", "order_date_key", "ship_date_key", "received_date_key", "delivery_delay_days", "delivered_count", "delayed_count")


def fact_delivery_roles(spark, sf):
    return deliveries(spark, sf)


def returns(spark, sf, products):
    s = sales(spark, sf, products=products, keep=F.col("l_returnflag").isin("R"))
    return s.select("order_id", "line_number", "product_key", "order_date_key", F.col("quantity").alias("return_quantity"), F.col("net_amount").alias("refund_amount"))


def fact_return(spark, sf):
    return returns(spark, sf, dim_product(spark, sf)).withColumns({c: F.col(c).cast("double") for c in ("return_quantity", "refund_amount")})


# Views


def vw_daily_sales(spark, sf):
    return views.daily_sales(sale_lines(spark, sf).join(order_days(spark, sf), "order_id"))


def vw_product_performance(spark, sf):
    return views.product_performance(sale_lines(spark, sf), product_rows(spark, sf), returned=F.col("return_flag") == "R", key="product_id")


def vw_customer_segment(spark, sf):
    return views.segment_sales(order_rows(spark, sf), customer_rows(spark, sf).select("customer_id", "segment", "region"), key="customer_id")


def vw_order_status(spark, sf):
    return views.status_by_month(order_rows(spark, sf))


def vw_shipment_performance(spark, sf):
    return views.shipment_performance(delivered_lines(spark, sf))


def vw_return_analysis(spark, sf):
    back = sale_lines(spark, sf, F.col("l_returnflag").isin("R"))
    return views.return_analysis(back.withColumnsRenamed({"quantity": "return_quantity", "net_amount": "refund_amount"}), product_rows(spark, sf), key="product_id")


def vw_stock_risk(spark, sf):
    p = read(spark, sf, "part")
    stock = p.select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("long").alias("available"), F.when(F.col("p_brand") < "Brand#3", 25).otherwise(10).cast("long").alias("reorder_level"))
    return views.stock_risk(stock)


def top_products(spark, sf):
    return views.top_products(sale_lines(spark, sf), product_rows(spark, sf), 20, key="product_id")


# Checks


def check_row_counts(spark, sf):
    counts = checks.row_counts(star(spark, sf))
    return counts.select("table_name", "row_count", (F.col("row_count") == 25).alias("is_25"), (F.col("row_count") >= 25).alias("at_least_25"))


def _row_checks(spark, sf, wanted):
    data = star(spark, sf)
    parts = [checks.row_checks(MODEL.table(t), df, meanings(MODEL), kinds={wanted}) for t, df in data.items()]
    return reduce(DataFrame.unionAll, parts).select("table_name", "columns", "violations")


def check_not_null(spark, sf):
    return _row_checks(spark, sf, "required")


def check_length(spark, sf):
    return _row_checks(spark, sf, "length")


def check_numeric(spark, sf):
    return _row_checks(spark, sf, "digits")


def check_constraints(spark, sf):
    return _row_checks(spark, sf, "check")


def check_placeholders(spark, sf):
    data = star(spark, sf)
    named = {"customer": "c_name", "supplier": "s_name", "part": "p_name", "nation": "n_name"}
    parts = [
        data[t].select(F.lit(t).alias("table_name"), F.regexp_replace(c, "#0*", " 0").alias("spaced"), F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+0*", "_")).alias("joined")).agg(
            F.first("table_name").alias("table_name"), F.count_if(fn.semantic_placeholder(F.col("spaced"))).alias("semantic"), F.count_if(fn.placeholder(F.col("joined"))).alias("placeholder"))
        for t, c in named.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def check_type_castable(spark, sf):
    e = read(spark, sf, "events")
    raw = e.select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("value").cast("string").alias("value"), F.col("ts").cast("string").alias("ts"))
    table = parse_ddl("CREATE TABLE stg_event (k integer, event_type date, value integer, ts timestamp)").table("stg_event")
    return checks.row_checks(table, raw).filter("check_id = 'type'").select("columns", "violations")


def check_pk_duplicates(spark, sf):
    return checks.duplicate_keys(read(spark, sf, "lineitem"), *MODEL.table("lineitem").primary_key)


def check_unique_duplicates(spark, sf):
    return checks.duplicate_keys(read(spark, sf, "events"), *MODEL.table("events").uniques[0].columns)


def _relations(spark, sf):
    """All foreign keys, and lineitem to part again with half the parts gone."""
    data = star(spark, sf)
    for t in MODEL.tables:
        for fk in t.foreign_keys:
            yield t.name, fk, data[t.name], data[fk.parent], fk.parent
    fk = MODEL.table("lineitem").foreign_keys[1]
    yield "lineitem", fk, data["lineitem"], data["part"].filter("p_partkey % 2 = 0"), "even part"


def check_fk_orphans(spark, sf):
    """Orphans of every relation, counted together: one grouping after the joins."""
    named = [(t, ", ".join(fk.columns), name) for t, fk, _, _, name in _relations(spark, sf)]
    parts = [checks.orphans(child, fk.columns, parent, fk.parent_columns).select(F.lit(k).alias("relation")) for k, (_, fk, child, parent, _) in enumerate(_relations(spark, sf))]
    found = reduce(DataFrame.unionAll, parts).groupBy("relation").agg(F.count(F.lit(1)).alias("orphans"))
    every = spark.createDataFrame([(k, *x) for k, x in enumerate(named)], "relation int, child string, columns string, parent string")
    return every.join(found, "relation", "left").select("child", "columns", "parent", F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"))


def fk_reuse_stats(spark, sf):
    parts = [
        checks.reuse(child, fk.columns, parent, fk.parent_columns).select(
            F.lit(t).alias("child"), F.lit(", ".join(fk.columns)).alias("columns"), F.lit(name).alias("parent"), "child_rows", "skipped", "unresolved", "parents_used", "parents_reused", "parent_rows", "artificial")
        for t, fk, child, parent, name in _relations(spark, sf)
    ]
    return reduce(DataFrame.unionAll, parts)


def lineage_raw_staging(spark, sf):
    """Staged orders that raw records lack: all records, and those of two thirds of the orders; both sides are grouped once."""
    raw = raw_items(spark, sf).select(F.get_json_object("source_payload", "$.order_id").cast("long").alias("order_id"))
    staged = staged_items(spark, sf).select("order_id")
    sides = staged.select("order_id", F.lit(False).alias("raw")).unionAll(raw.select("order_id", F.lit(True)))
    by_order = sides.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.bool_or(~F.col("raw")).alias("staged"), F.bool_or("raw").alias("raw"), F.bool_or(F.col("raw") & (F.col("order_id") % 3 != 0)).alias("two_thirds"))
    lost = by_order.filter("staged").agg(F.count_if(~F.col("raw")).alias("whole"), F.count_if(~F.col("two_thirds")).alias("without thirds"))
    return lost.unpivot([], ["whole", "without thirds"], "source", "missing_values")


def lineage_staging_dim(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    dim = dim_customer(spark, sf).select("customer_id")
    both = checks.not_contained(dim, "customer_id", [c.select(F.col("c_custkey").alias("customer_id")), o.select(F.col("o_custkey").alias("customer_id"))])
    buyers = checks.not_contained(dim, "customer_id", [o.select(F.col("o_custkey").alias("customer_id"))])
    n = F.count(F.lit(1)).alias("missing_values")
    return both.agg(n).select(F.lit("customers and orders").alias("source"), "missing_values").unionAll(buyers.agg(n).select(F.lit("orders").alias("source"), "missing_values"))


def lineage_fact_dim(spark, sf):
    """Fact rows without a product, in the whole dimension and in its first 100 rows; the fact is read once."""
    p = dim_product(spark, sf)
    f = elt.look_up(staged_items(spark, sf).select(F.col("part_id").alias("product_id")), p, "product_id", "product_key")
    keys = p.select(F.col("product_key").alias("known"), (F.col("product_key") <= 100).alias("early"))
    joined = f.groupBy("product_key").agg(F.count(F.lit(1)).alias("n")).join(keys, F.col("product_key") == F.col("known"), "left")
    lost = lambda c: F.coalesce(F.sum(F.when(~F.coalesce(c, F.lit(False)), F.col("n"))), F.lit(0))
    both = joined.agg(F.array(F.struct(F.lit("whole").alias("dimension"), lost(F.col("known").isNotNull()).alias("unresolved")), F.struct(F.lit("first 100").alias("dimension"), lost(F.col("early")).alias("unresolved"))).alias("x"))
    return both.select(F.inline("x"))


def temporal_span(spark, sf):
    data = star(spark, sf)
    return checks.temporal_span({"orders": (data["orders"], ["o_orderdate"]), "lineitem": (data["lineitem"], ["l_shipdate"]), "events": (data["events"], ["ts"])})


def uniform_row_counts(spark, sf):
    data = star(spark, sf)
    some = checks.uniform_counts(checks.row_counts(data)).select(F.lit("star").alias("tables"), "*")
    same = checks.uniform_counts(checks.row_counts({k: data["nation"] for k in ("a", "b", "c", "d")})).select(F.lit("four alike").alias("tables"), "*")
    return some.unionAll(same)


def layer_reconciliation(spark, sf):
    """Rows of each layer; the fact is counted by the look-ups that may drop rows, without making keys."""
    orders, products = order_rows(spark, sf).join(customer_rows(spark, sf).select("customer_id"), "customer_id", "left_semi"), product_rows(spark, sf)
    fact = sale_lines(spark, sf).select("order_id", "product_id").join(orders.select("order_id"), "order_id", "left_semi").join(products, "product_id", "left_semi")
    return checks.row_counts({"raw": raw_items(spark, sf), "staging": staged_items(spark, sf), "dimension": orders, "fact": fact})


# Generation


def gen_business_ids(spark, sf):
    i = F.col("id")
    ids = read(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"))
    return ids.select("id", fn.business_id("customer_id", i).alias("customer_id"), fn.business_id("order_id", i).alias("order_id"), fn.text_key("dim_store", i).alias("store_key"), fn.cyclic_date_key(i).alias("date_key"))


def _parents(spark, sf, table: str, key: str, name: str):
    """A given table as parents of generated rows, numbered in order of its key (which has no gaps), and its size."""
    rows = read(spark, sf, table)
    return rows.select((F.col(key) + 1).alias("_row"), F.col(key).cast("long").alias(name)), rows.count()


_CHILD = "CREATE TABLE customer (customer_id bigint PRIMARY KEY); CREATE TABLE visit (visit_id bigint PRIMARY KEY, customer_id bigint REFERENCES customer)"


def gen_fk_modulo(spark, sf):
    """As many visits as there are orders, whose customers are taken in turn."""
    model = parse_ddl(_CHILD)
    visits = table_rows(spark, model.table("visit"), read(spark, sf, "orders").count(), {"customer": _parents(spark, sf, "customer", "c_custkey", "customer_id")}, meanings(model))
    return visits.select("visit_id", "customer_id")


_OFFER = "CREATE TABLE part (part_id bigint PRIMARY KEY); CREATE TABLE supplier (supplier_id bigint PRIMARY KEY); CREATE TABLE offer (part_id bigint REFERENCES part, supplier_id bigint REFERENCES supplier, UNIQUE (part_id, supplier_id))"


def gen_unique_pairs(spark, sf):
    """Three offers for each part: pairs of part and supplier, all distinct."""
    model, parents = parse_ddl(_OFFER), {"part": _parents(spark, sf, "part", "p_partkey", "part_id"), "supplier": _parents(spark, sf, "supplier", "s_suppkey", "supplier_id")}
    return table_rows(spark, model.table("offer"), 3 * parents["part"][1], parents, meanings(model)).select("part_id", "supplier_id")


_TRIPLE = """CREATE TABLE customer (customer_id bigint PRIMARY KEY); CREATE TABLE part (part_id bigint PRIMARY KEY); CREATE TABLE supplier (supplier_id bigint PRIMARY KEY);
CREATE TABLE quote (customer_id bigint REFERENCES customer, part_id bigint REFERENCES part, supplier_id bigint REFERENCES supplier, UNIQUE (customer_id, part_id), UNIQUE (part_id, supplier_id))"""


def gen_unique_sets(spark, sf):
    """Quotes with two UNIQUE sets that share the part: rows, distinct tuples of each set, values of each column and rows without a parent."""
    model = parse_ddl(_TRIPLE)
    parents = {t: _parents(spark, sf, t, k, f"{t}_id") for t, k in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))}
    quotes = table_rows(spark, model.table("quote"), read(spark, sf, "orders").count(), parents, meanings(model))
    pairs = [quotes.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias(name)) for k, name in ((("customer_id", "part_id"), "customer_part"), (("part_id", "supplier_id"), "part_supplier"))]
    seen = quotes.agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("customer_id").isNull() | F.col("part_id").isNull() | F.col("supplier_id").isNull()).alias("orphans"), F.count_distinct("part_id").alias("parts"))
    return seen.crossJoin(pairs[0]).crossJoin(pairs[1])  # one row each


def gen_uneven_reuse(spark, sf):
    """As many visits as there are line items, whose customers follow a power law: how far the share of the busiest ones is from it at most."""
    model, exponent = parse_ddl(_CHILD), 0.8
    frame, m = _parents(spark, sf, "customer", "c_custkey", "customer_id")
    visits = table_rows(spark, model.table("visit"), read(spark, sf, "lineitem").count(), {"customer": (frame, m)}, meanings(model), reuse=exponent)
    often = visits.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    by_number = often.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))  # one row a number of visits
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    top = by_number.select(F.sum("customers").over(down).alias("top"), F.sum(F.col("n") * F.col("customers")).over(down).alias("of_top"), F.col("n"), F.col("customers"))
    law = (F.pow(F.col("top") + 1.0, F.lit(1 - exponent)) - 1) / ((m + 1.0) ** (1 - exponent) - 1)
    total = often.agg(F.sum("n").alias("visits"), F.count_if(F.col("customer_id").isNull()).alias("orphans"))
    return top.crossJoin(total).groupBy("visits", "orphans").agg((F.max(F.abs(F.col("of_top") / F.col("visits") - law)) < 0.03).alias("follows_the_law"), (F.max("n") > 10 * F.min("n")).alias("uneven"))


def gen_check_cycle(spark, sf):
    model = parse_ddl("CREATE TABLE item (item_key bigint PRIMARY KEY, status varchar(10) CHECK (status IN ('New', 'Open', 'Done')), score integer CHECK (score BETWEEN 1 AND 10), flag boolean)")
    return table_rows(spark, model.table("item"), read(spark, sf, "part").count(), {}, meanings(model)).select("item_key", "status", "score", "flag")


def calc_measures(spark, sf):
    l = read(spark, sf, "lineitem")
    rows = l.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(14,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("unit_price"), F.lit(0).cast("decimal(18,2)").alias("line_total"),
        F.col("l_shipdate").alias("promised_at"), F.timestamp_add("HOUR", (F.col("l_linenumber") - 3) * 24, F.col("l_shipdate")).alias("actual_at"), F.lit(0).cast("long").alias("delay_minutes"), F.lit(False).alias("is_delayed"),
    )
    return derive.calculate(rows).withColumns({c: F.col(c).cast("double") for c in ("quantity", "unit_price", "line_total")}).drop("promised_at", "actual_at")


def repair_metrics(spark, sf):
    l = read(spark, sf, "lineitem")
    rows = l.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_linenumber") - 3).cast("long").alias("delay_minutes"), F.lit(9).cast("long").alias("delayed_count"), F.lit(None).cast("boolean").alias("is_delayed"),
        F.col("l_quantity").alias("on_hand_quantity"), F.col("l_linenumber").cast("double").alias("reserved_quantity"), F.lit(0.0).alias("available_quantity"),
    )
    return derive.repair_metrics(rows)


def lifecycle_fix(spark, sf):
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", F.col("o_orderdate").alias("ordered_at"), F.timestamp_add("DAY", F.lit(60), F.col("o_orderdate")).alias("promised_at"), F.col("l_shipdate").alias("actual_at"),
        F.timestamp_add("DAY", F.lit(-5), F.col("o_orderdate")).alias("paid_at"),
    )
    return derive.order_dates(derive.mirror_after(joined, "promised_at", "actual_at"), "ordered_at", "paid_at")


def cell_safe_export(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select("event_id", F.concat(F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "a"])), (F.col("event_id") % 5 + 1).cast("int")), "event_type").alias("said"), F.col("value").cast("decimal(14,2)").alias("amount"), F.col("event_type").cast("binary").alias("raw"), "ts")
    return safe_cells(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        project_customer, stg_order_item_from_raw, stg_event_props, payload_required_keys, dim_date_calendar, dim_customer_surrogate, dim_order_surrogate, fact_sales,
        fact_delivery_roles, fact_return, vw_daily_sales, vw_product_performance, vw_customer_segment, vw_order_status, vw_shipment_performance, vw_return_analysis,
        vw_stock_risk, top_products, check_row_counts, check_not_null, check_length, check_numeric, check_type_castable, check_pk_duplicates, check_unique_duplicates,
        check_constraints, check_fk_orphans, fk_reuse_stats, check_placeholders, lineage_raw_staging, lineage_staging_dim, lineage_fact_dim, temporal_span,
        uniform_row_counts, layer_reconciliation, gen_business_ids, gen_fk_modulo, gen_unique_pairs, gen_unique_sets, gen_uneven_reuse, gen_check_cycle, calc_measures,
        repair_metrics, lifecycle_fix, cell_safe_export,
    )
}
