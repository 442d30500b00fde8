"""Layered analytical warehouses on Spark: read a schema, plan its layers, load, generate and check them."""
