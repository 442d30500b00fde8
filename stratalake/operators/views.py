"""Reporting views over facts and dimensions.

Money is summed as decimal(14, 2), so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(14,2)"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def daily_sales(sales: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Orders, quantity, gross, discount, net and average order value a day.

    The day is the sales' own ``order_date``, or with ``dates`` that of their ``order_date_key``.
    """
    if dates is None:
        joined = sales.filter(F.col("order_date").isNotNull()).withColumnRenamed("order_date", "full_date")
    else:
        joined = sales.join(dates.select("date_key", "full_date"), sales["order_date_key"] == dates["date_key"])
    sums = joined.groupBy("full_date").agg(
        F.count_distinct("order_id").alias("order_count"), money("quantity").alias("q"), money("gross_amount").alias("g"),
        money("discount_amount").alias("d"), money("net_amount").alias("n"),
    )
    return sums.select(
        "full_date", "order_count", F.col("q").cast("double").alias("quantity_sold"), F.col("g").cast("double").alias("gross_sales"),
        F.col("d").cast("double").alias("discounts"), F.col("n").cast("double").alias("net_sales"), ratio(F.col("n"), F.col("order_count")).alias("average_order_value"),
    )


def product_performance(sales: DataFrame, products: DataFrame, returns: DataFrame | None = None, returned: Column | None = None, key: str = "product_key") -> DataFrame:
    """Units, revenue, average price and return rate of each product; ``key`` names the column that sales and products share.

    Returns are rows of their own, summed a product before they meet sales, or
    the sales lines for which ``returned`` holds, summed in the same pass.
    """
    back = F.sum(F.when(returned, F.col("quantity").cast("decimal(14,2)"))) if returned is not None else F.lit(None).cast("decimal(24,2)")
    sold = sales.groupBy(key).agg(money("quantity").alias("u"), money("net_amount").alias("r"), back.alias("b"))
    if returns is not None:
        sold = sold.drop("b").join(returns.groupBy(key).agg(money("return_quantity").alias("b")), key, "left")
    joined = products.join(sold, key)
    return joined.select(
        "product_id", "product_name", "brand", "category", "size", F.col("u").cast("double").alias("units_sold"), F.col("r").cast("double").alias("revenue"),
        ratio(F.col("r"), F.col("u")).alias("average_selling_price"), ratio(F.coalesce(F.col("b"), F.lit(0).cast("decimal(24,2)")), F.col("u")).alias("return_rate"),
    )


def segment_sales(orders: DataFrame, customers: DataFrame, key: str = "customer_key") -> DataFrame:
    """Customers, orders and revenue of each segment and region."""
    joined = orders.join(customers, key)
    sums = joined.groupBy("segment", "region").agg(F.count_distinct(key).alias("customers"), F.count(F.lit(1)).alias("orders"), money("total_price").alias("r"))
    return sums.select("segment", "region", "customers", "orders", F.col("r").cast("double").alias("revenue"), ratio(F.col("r"), F.col("customers")).alias("revenue_per_customer"))


def status_by_month(orders: DataFrame) -> DataFrame:
    """Orders and amount of each status, priority and month."""
    sums = orders.groupBy(F.trunc("order_date", "month").alias("month"), "status", "priority").agg(F.count(F.lit(1)).alias("order_count"), money("total_price").alias("a"))
    return sums.select("month", "status", "priority", "order_count", F.col("a").cast("double").alias("amount"))


def shipment_performance(deliveries: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Shipments, delivered and delayed ones and the average delay of each day and line status; open ones have no delay.

    The day is the deliveries' own ``shipped``, or with ``dates`` that of their ``ship_date_key``.
    """
    if dates is None:
        joined = deliveries.filter(F.col("shipped").isNotNull()).withColumnRenamed("shipped", "full_date")
    else:
        joined = deliveries.join(dates.select("date_key", "full_date"), deliveries["ship_date_key"] == dates["date_key"])
    return joined.groupBy("full_date", "line_status").agg(
        F.count(F.lit(1)).alias("shipment_count"), F.sum("delivered_count").cast("long").alias("delivered_shipments"),
        F.sum("delayed_count").cast("long").alias("delayed_shipments"), F.avg("delivery_delay_days").alias("average_delivery_delay"),
    )


def return_analysis(returns: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """Returns, quantity and refund of each brand and category."""
    joined = returns.join(products.select(key, "brand", "category"), key)
    sums = joined.groupBy("brand", "category").agg(F.count(F.lit(1)).alias("return_count"), money("return_quantity").alias("q"), money("refund_amount").alias("a"))
    return sums.select("brand", "category", "return_count", F.col("q").cast("double").alias("returned_quantity"), F.col("a").cast("double").alias("refund_amount"))


def stock_risk(stock: DataFrame) -> DataFrame:
    """Each product's stock with its reorder level and whether it is at or below it."""
    return stock.withColumn("reorder_risk", F.col("available") <= F.col("reorder_level"))


def top_products(sales: DataFrame, products: DataFrame, n: int, key: str = "product_key") -> DataFrame:
    """The ``n`` products of the highest revenue; ties go to the smaller id."""
    sold = sales.groupBy(key).agg(money("net_amount").alias("r"))
    best = sold.join(products.select(*dict.fromkeys((key, "product_id", "product_name"))), key).orderBy(F.desc("r"), "product_id").limit(n)
    return best.select("product_id", "product_name", F.col("r").cast("double").alias("revenue"))
