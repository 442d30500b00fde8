"""Connected components of a table of links, as alternating large and small stars.

Every round makes each node point at smaller neighbours until all nodes of a
component point at its smallest; a round is two joins with pre-aggregated
minima, and its result is a written table.  Nothing is collected: the driver
sees one count and one checksum a round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import discard, written


def _contract(batches):
    """Union-find within a task: as many links as nodes at most, to the smallest node seen there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out():
        rows = [(x, root(x)) for x in parent]
        parent.clear()
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 1_000_000:
            yield out()
    yield out()


#: Links that one task contracts at once.
AT_ONCE = 200_000


def components(links: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b) that isn't its component's smallest.

    ``links`` should be a written table.  Links are contracted by tasks of about
    ``at_once`` links; where one task holds them all, that settles them.
    """
    both = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v")
    parts = max(1, -(-both.count() // at_once))

    def contracted(df: DataFrame) -> DataFrame:
        return df.coalesce(parts).mapInArrow(_contract, "u long, v long")

    def out(df: DataFrame) -> DataFrame:
        return df.select(F.col("u").alias("node"), F.col("v").alias("component"))

    edges = written(contracted(both).distinct().coalesce(parts), "links")
    if parts == 1:
        return out(edges)
    for _ in range(rounds):
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        chained = edges.select(F.col("v").alias("at")).join(edges, F.col("at") == F.col("u"), "left_semi")
        if several.isEmpty() and chained.isEmpty():  # each node points at one that points nowhere
            return out(edges)
        every = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(contracted(small).distinct(), "links")
        discard(edges, large)
        edges = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
