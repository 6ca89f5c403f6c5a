"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node identifier that is reachable, for every node that an edge names.

    Alternating large-star and small-star steps, each a shuffle of the edges with no group collected: a node's edges are rewired to
    its smallest neighbour by a window minimum. Ends when a step changes nothing, after about log(n) steps. Self-loops
    are allowed; null ends are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = materialize(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the smaller neighbours of a node, and the node, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        now = _mark(e)
        if now == seen:
            break
        seen = now
    root = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(e: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

