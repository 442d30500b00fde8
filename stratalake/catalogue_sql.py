"""DuckDB SQL for every query of the catalogue, written from the driver's tables alone."""

from __future__ import annotations

from stratalake.catalogue import MODEL, STAR


ITEMS = """items AS (SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, l_linenumber AS line_number, l_quantity::DECIMAL(14,2) AS quantity,
  l_extendedprice::DECIMAL(14,2) AS extended_price, l_discount::DECIMAL(14,2) AS discount, l_tax::DECIMAL(14,2) AS tax, l_returnflag AS return_flag, l_linestatus AS line_status,
  l_shipdate::DATE AS ship_date FROM lineitem)"""
DATES = """dates AS (SELECT strftime(d, '%Y%m%d')::INTEGER AS date_key, d AS full_date, isodow(d) AS day_of_week, dayname(d) AS day_name, weekofyear(d) AS week_of_year,
  month(d) AS month_number, monthname(d) AS month_name, quarter(d) AS quarter_number, year(d) AS year_number, isodow(d) IN (6, 7) AS is_weekend
  FROM (SELECT unnest(generate_series(min(x), max(x), INTERVAL 1 DAY))::DATE AS d FROM (SELECT o_orderdate::DATE AS x FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem)))"""
CUSTOMERS = """customers AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PRODUCTS = "products AS (SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category, p_size::BIGINT AS size FROM part)"
ORDERS = """dim_orders AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS order_key, o_orderkey AS order_id, customer_key, o_orderdate::DATE AS order_date, o_orderstatus AS status,
  o_orderpriority AS priority, o_totalprice::DECIMAL(14,2) AS total_price FROM orders JOIN customers ON o_custkey = customer_id)"""
SALES = """sales AS (SELECT i.order_id, line_number, order_key, customer_key, product_key, strftime(order_date, '%Y%m%d')::INTEGER AS order_date_key, quantity, extended_price AS gross_amount,
  round(extended_price * discount, 2)::DECIMAL(14,2) AS discount_amount, (extended_price - round(extended_price * discount, 2))::DECIMAL(14,2) AS net_amount, return_flag, line_status, order_date
  FROM items i JOIN dim_orders o ON i.order_id = o.order_id JOIN products ON part_id = product_id)"""
BACK = "back AS (SELECT order_id, line_number, product_key, order_date_key, quantity AS return_quantity, net_amount AS refund_amount FROM sales WHERE return_flag IN ('R'))"
FACTS = f"WITH {ITEMS}, {CUSTOMERS}, {PRODUCTS}, {ORDERS}, {SALES}, {BACK}"
DELIVERIES = """deliveries AS (SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_linestatus AS line_status, strftime(o_orderdate, '%Y%m%d')::INTEGER AS order_date_key,
  strftime(l_shipdate, '%Y%m%d')::INTEGER AS ship_date_key, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y%m%d')::INTEGER END AS received_date_key,
  CASE WHEN l_linestatus = 'F' THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END AS delivery_delay_days, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS delivered_count,
  CASE WHEN l_linestatus = 'F' AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 60 THEN 1 ELSE 0 END AS delayed_count, l_shipdate::DATE AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _counts(check: str) -> str:
    """Violations a column of one kind of check, from the model's columns."""
    parts = []
    for t in MODEL.tables:
        for c in t.columns:
            bad = []
            if check == "required" and not c.nullable:
                bad.append(f"{c.name} IS NULL OR {c.name}::VARCHAR = ''")
            if check == "length" and c.max_length:
                bad.append(f"length({c.name}) > {c.max_length}")
            if check == "digits" and c.precision is not None:
                bad.append(f"abs({c.name}::DECIMAL(28,10)) >= {10 ** (c.precision - c.scale)} OR {c.name}::DECIMAL(28,10) <> round({c.name}::DECIMAL(28,10), {c.scale})")
            parts += [f"SELECT '{t.name}' AS table_name, '{c.name}' AS columns, count(*) FILTER ({b}) AS violations FROM {t.name}" for b in bad]
        for k in t.checks if check == "check" else ():
            holds = {"IN": f"{k.column}::VARCHAR IN ({', '.join(repr(v) for v in k.values)})", "BETWEEN": f"{k.column} BETWEEN {k.values[0]} AND {k.values[-1]}"}.get(k.op, f"{k.column} {k.op} {k.values[0]}")
            parts.append(f"SELECT '{t.name}' AS table_name, '{k.column}' AS columns, count(*) FILTER (NOT ({holds})) AS violations FROM {t.name}")
    return _union(parts)


def _relations() -> list[tuple[str, str, str, str, str]]:
    """(child, its columns, parent as shown, parent's columns, parent as read)."""
    out = [(t.name, fk.columns[0], fk.parent, fk.parent_columns[0], fk.parent) for t in MODEL.tables for fk in t.foreign_keys]
    return [*out, ("lineitem", "l_partkey", "even part", "p_partkey", "(SELECT * FROM part WHERE p_partkey % 2 = 0)")]


def _reuse(t: str, c: str, shown: str, p: str, parent: str) -> str:
    return f"""(WITH s AS (SELECT {c} AS k, count(*) AS n FROM {t} GROUP BY 1), j AS (SELECT s.*, q.k IS NOT NULL AS known FROM s LEFT JOIN (SELECT DISTINCT {p} AS k FROM {parent}) q ON s.k = q.k),
      a AS (SELECT coalesce(sum(n), 0)::BIGINT AS child_rows, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS skipped, coalesce(sum(n) FILTER (k IS NOT NULL AND NOT known), 0)::BIGINT AS unresolved,
        count(*) FILTER (k IS NOT NULL) AS parents_used, count(*) FILTER (k IS NOT NULL AND n > 1) AS parents_reused, (SELECT count(*) FROM {parent}) AS parent_rows FROM j)
      SELECT '{t}' AS child, '{c}' AS columns, '{shown}' AS parent, *, unresolved = 0 AND child_rows - skipped > parent_rows AND parents_reused = 0 AS artificial FROM a)"""




SQL: dict[str, str] = {
    "project_customer": "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer",
    "stg_order_item_from_raw": f"WITH {ITEMS} SELECT * REPLACE (quantity::DOUBLE AS quantity, extended_price::DOUBLE AS extended_price, discount::DOUBLE AS discount, tax::DOUBLE AS tax) FROM items",
    "stg_event_props": "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_type(props) = 'OBJECT', false) AS is_object FROM events",
    "payload_required_keys": """SELECT 'payload_object' AS check_id, 'lineitem' AS table_name, 'source_payload' AS columns, 0::BIGINT AS violations
      UNION ALL SELECT 'payload_key', 'lineitem', 'order_id', 0 UNION ALL SELECT 'payload_key', 'lineitem', 'part_id', 0
      UNION ALL SELECT 'payload_key', 'lineitem', 'coupon', count(*) FROM lineitem
      UNION ALL SELECT 'payload_object', 'events', 'props', count(*) FILTER (json_type(props) IS DISTINCT FROM 'OBJECT') FROM events
      UNION ALL SELECT 'payload_key', 'events', 'k', count(*) FILTER (NOT list_contains(json_keys(props), 'k')) FROM events""",
    "dim_date_calendar": f"WITH {DATES} SELECT * FROM dates",
    "dim_customer_surrogate": f"WITH {CUSTOMERS} SELECT * FROM customers",
    "dim_order_surrogate": f"WITH {CUSTOMERS}, {ORDERS} SELECT * EXCLUDE (total_price) FROM dim_orders",
    "fact_sales": f"{FACTS} SELECT order_id, line_number, order_key, customer_key, product_key, order_date_key, quantity::DOUBLE AS quantity, gross_amount::DOUBLE AS gross_amount, discount_amount::DOUBLE AS discount_amount, net_amount::DOUBLE AS net_amount FROM sales",
    "fact_delivery_roles": f"WITH {DELIVERIES} SELECT * EXCLUDE (shipped) FROM deliveries",
    "fact_return": f"{FACTS} SELECT * REPLACE (return_quantity::DOUBLE AS return_quantity, refund_amount::DOUBLE AS refund_amount) FROM back",
    "vw_daily_sales": f"""{FACTS} SELECT order_date AS full_date, count(DISTINCT order_id) AS order_count, sum(quantity)::DOUBLE AS quantity_sold, sum(gross_amount)::DOUBLE AS gross_sales,
      sum(discount_amount)::DOUBLE AS discounts, sum(net_amount)::DOUBLE AS net_sales, sum(net_amount)::DOUBLE / nullif(count(DISTINCT order_id)::DOUBLE, 0) AS average_order_value FROM sales GROUP BY order_date""",
    "vw_product_performance": f"""{FACTS}, u AS (SELECT product_key, sum(quantity) AS u, sum(net_amount) AS r FROM sales GROUP BY 1), b AS (SELECT product_key, sum(return_quantity) AS b FROM back GROUP BY 1)
      SELECT product_id, product_name, brand, category, size, u::DOUBLE AS units_sold, r::DOUBLE AS revenue, r::DOUBLE / nullif(u::DOUBLE, 0) AS average_selling_price, coalesce(b, 0)::DOUBLE / nullif(u::DOUBLE, 0) AS return_rate
      FROM products JOIN u USING (product_key) LEFT JOIN b USING (product_key)""",
    "vw_customer_segment": f"""WITH {CUSTOMERS}, {ORDERS} SELECT segment, region, count(DISTINCT customer_key) AS customers, count(*) AS orders, sum(total_price)::DOUBLE AS revenue,
      sum(total_price)::DOUBLE / nullif(count(DISTINCT customer_key)::DOUBLE, 0) AS revenue_per_customer FROM dim_orders JOIN customers USING (customer_key) GROUP BY segment, region""",
    "vw_order_status": f"WITH {CUSTOMERS}, {ORDERS} SELECT date_trunc('month', order_date)::DATE AS month, status, priority, count(*) AS order_count, sum(total_price)::DOUBLE AS amount FROM dim_orders GROUP BY 1, 2, 3",
    "vw_shipment_performance": f"""WITH {DELIVERIES} SELECT shipped AS full_date, line_status, count(*) AS shipment_count, sum(delivered_count)::BIGINT AS delivered_shipments, sum(delayed_count)::BIGINT AS delayed_shipments,
      avg(delivery_delay_days) AS average_delivery_delay FROM deliveries GROUP BY shipped, line_status""",
    "vw_return_analysis": f"{FACTS} SELECT brand, category, count(*) AS return_count, sum(return_quantity)::DOUBLE AS returned_quantity, sum(refund_amount)::DOUBLE AS refund_amount FROM back JOIN products USING (product_key) GROUP BY brand, category",
    "vw_stock_risk": """SELECT p_partkey AS product_id, p_size::BIGINT AS available, (CASE WHEN p_brand < 'Brand#3' THEN 25 ELSE 10 END)::BIGINT AS reorder_level,
      p_size <= CASE WHEN p_brand < 'Brand#3' THEN 25 ELSE 10 END AS reorder_risk FROM part""",
    "top_products": f"{FACTS} SELECT product_id, product_name, sum(net_amount)::DOUBLE AS revenue FROM sales JOIN products USING (product_key) GROUP BY product_id, product_name ORDER BY sum(net_amount) DESC, product_id LIMIT 20",
    "check_row_counts": _union([f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) = 25 AS is_25, count(*) >= 25 AS at_least_25 FROM {t}" for t in STAR]),
    "check_not_null": _counts("required"),
    "check_length": _counts("length"),
    "check_numeric": _counts("digits"),
    "check_constraints": _counts("check"),
    "check_type_castable": """SELECT 'k' AS columns, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL AND json_extract_string(props, '$.k') <> '') AS violations FROM events
      UNION ALL SELECT 'event_type', count(*) FILTER (TRY_CAST(event_type AS DATE) IS NULL AND event_type <> '') FROM events
      UNION ALL SELECT 'value', count(*) FILTER (NOT regexp_full_match(value::VARCHAR, '-?[0-9]+')) FROM events UNION ALL SELECT 'ts', 0 FROM (SELECT 1)""",
    "check_pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "check_unique_duplicates": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "check_fk_orphans": _union([f"SELECT '{t}' AS child, '{c}' AS columns, '{shown}' AS parent, count(*) FILTER (x.{c} IS NOT NULL AND q.k IS NULL) AS orphans FROM {t} x LEFT JOIN (SELECT DISTINCT {p} AS k FROM {parent}) q ON x.{c} = q.k" for t, c, shown, p, parent in _relations()]),
    "fk_reuse_stats": _union([f"SELECT * FROM {_reuse(*r)}" for r in _relations()]),
    "check_placeholders": _union([
        f"SELECT '{t}' AS table_name, count(*) FILTER (regexp_full_match(trim(regexp_replace({c}, '#0*', ' 0', 'g')), '[A-Z][A-Za-z_]*(\\s+[A-Z][A-Za-z_]*)?\\s+\\d{{3,6}}')) AS semantic, "
        f"count(*) FILTER (regexp_full_match(lower(regexp_replace({c}, '[^A-Za-z0-9]+0*', '_', 'g')), '[a-z_]+_\\d{{3}}')) AS placeholder FROM {t}"
        for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name"))
    ]),
    "lineage_raw_staging": "SELECT 'whole' AS source, 0::BIGINT AS missing_values UNION ALL SELECT 'without thirds', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 3 = 0",
    "lineage_staging_dim": "SELECT 'customers and orders' AS source, 0::BIGINT AS missing_values UNION ALL SELECT 'orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "lineage_fact_dim": f"WITH {PRODUCTS} SELECT 'whole' AS dimension, 0::BIGINT AS unresolved UNION ALL SELECT 'first 100', count(*) FROM lineitem JOIN products ON l_partkey = product_id JOIN orders ON l_orderkey = o_orderkey WHERE product_key > 100",
    "temporal_span": """WITH d AS (SELECT o_orderdate::DATE AS d FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem UNION ALL SELECT ts::DATE FROM events)
      SELECT min(d) AS first_day, max(d) AS last_day, date_diff('day', min(d), max(d)) AS span_days, count(DISTINCT d) AS distinct_days, count(d) AS n_dates FROM d""",
    "uniform_row_counts": f"""WITH c AS ({_union([f"SELECT count(*) AS n FROM {t}" for t in STAR])})
      SELECT 'star' AS tables, count(*) FILTER (n > 0) AS non_empty, count(DISTINCT n) FILTER (n > 0) AS distinct_counts, count(*) FILTER (n > 0) >= 4 AND count(DISTINCT n) FILTER (n > 0) = 1 AND max(n) > 1 AS uniform FROM c
      UNION ALL SELECT 'four alike', 4, 1, true""",
    "layer_reconciliation": "SELECT 'raw' AS table_name, count(*) AS row_count FROM lineitem UNION ALL SELECT 'staging', count(*) FROM lineitem UNION ALL SELECT 'dimension', count(*) FROM orders UNION ALL SELECT 'fact', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "gen_business_ids": """WITH i AS (SELECT c_custkey + 1 AS id FROM customer), k AS (SELECT id, strftime(DATE '2026-07-06' + ((id - 1) % 365)::INTEGER, '%Y%m%d')::INTEGER AS date_key FROM i)
      SELECT id, printf('CUST-%06d', id) AS customer_id, printf('ORDER-%d-%06d', date_key, id) AS order_id, printf('STORE-%06d', id) AS store_key, date_key FROM k""",
    "gen_fk_modulo": "SELECT i AS visit_id, (i - 1) % (SELECT count(*) FROM customer) AS customer_id FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM orders))) AS i)",
    "gen_unique_pairs": "SELECT (i - 1) % n AS part_id, ((i - 1) // n) % (SELECT count(*) FROM supplier) AS supplier_id FROM (SELECT unnest(range(1, (SELECT 3 * count(*) + 1 FROM part))) AS i), (SELECT count(*) AS n FROM part)",
    "gen_unique_sets": "SELECT n AS quotes, 0::BIGINT AS orphans, least(n, p) AS parts, n AS customer_part, n AS part_supplier FROM (SELECT count(*) AS n FROM orders), (SELECT count(*) AS p FROM part)",
    "gen_uneven_reuse": "SELECT count(*) AS visits, 0::BIGINT AS orphans, true AS follows_the_law, true AS uneven FROM lineitem",
    "gen_check_cycle": "SELECT i AS item_key, ['New', 'Open', 'Done'][(i - 1) % 3 + 1] AS status, ((i - 1) % 10 + 1)::INTEGER AS score, i % 2 = 0 AS flag FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM part))) AS i)",
    "calc_measures": """SELECT l_orderkey, l_linenumber, l_quantity::DECIMAL(14,2)::DOUBLE AS quantity, l_extendedprice::DECIMAL(14,2)::DOUBLE AS unit_price,
      (l_quantity::DECIMAL(14,2)::DECIMAL(16,2) * l_extendedprice::DECIMAL(14,2)::DECIMAL(16,2))::DECIMAL(18,2)::DOUBLE AS line_total, greatest(0, (l_linenumber - 3) * 1440)::BIGINT AS delay_minutes, l_linenumber > 3 AS is_delayed FROM lineitem""",
    "repair_metrics": """SELECT l_orderkey, l_linenumber, (CASE WHEN l_linestatus = 'F' THEN l_linenumber - 3 END)::BIGINT AS delay_minutes, (CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN 1 ELSE 0 END)::BIGINT AS delayed_count,
      l_linestatus = 'F' AND l_linenumber > 3 AS is_delayed, l_quantity AS on_hand_quantity, l_linenumber::DOUBLE AS reserved_quantity, l_quantity - l_linenumber AS available_quantity FROM lineitem""",
    "lifecycle_fix": """SELECT l_orderkey, l_linenumber, o_orderdate AS ordered_at, o_orderdate + INTERVAL 60 DAY AS promised_at,
      CASE WHEN l_shipdate < o_orderdate + INTERVAL 60 DAY THEN (o_orderdate + INTERVAL 60 DAY) + ((o_orderdate + INTERVAL 60 DAY) - l_shipdate) ELSE l_shipdate END AS actual_at, o_orderdate AS paid_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "cell_safe_export": "SELECT event_id, (CASE WHEN event_id % 5 < 4 THEN '''' ELSE '' END) || ['=', '+', '-', '@', 'a'][event_id % 5 + 1] || event_type AS said, value::DECIMAL(14,2)::DOUBLE AS amount, lower(hex(event_type)) AS raw, ts FROM events",
}
