"""Graphs as edge tables: components, bounded traversal, closure, cycles and layers.

Every iteration is checkpointed in the shared folder; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.durable import durable


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (its smallest node) for undirected ``links`` (a, b) over ``nodes`` (node).

    Alternates large-star and small-star steps, which end after a number of rounds logarithmic in the path lengths and
    never gather a node's neighbours into one row.
    """
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = None
    while True:
        both = edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")).unionByName(edges.select(F.col("hi").alias("v"), F.col("lo").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("w > v").select(F.col("m").alias("lo"), F.col("w").alias("hi")).where("lo <> hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo <> hi").distinct()
        edges = durable(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth (the least number of steps from ``start``, a node table) within ``depth`` steps along edges (src, dst)."""
    seen = durable(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        front = durable(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = durable(seen.unionByName(front))
    return seen


def two_hops(edges: DataFrame, start: DataFrame, decay: float = 0.5) -> DataFrame:
    """node, score: the best of weight (one step) and weight * weight * ``decay`` (two steps) from ``start``."""
    one = start.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("score"))
    two = one.select(F.col("node").alias("src"), F.col("score").alias("s")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("s") * F.col("weight") * decay).alias("score"))
    return one.unionByName(two).groupBy("node").agg(F.round(F.max("score"), 6).alias("score")).join(start.select("node"), "node", "left_anti")


def layers(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, layer: the longest way from a node without incoming edges; null for nodes on a cycle or behind one."""
    nodes = durable(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    left, placed = edges, nodes.limit(0).withColumn("layer", F.lit(0))
    rest = nodes
    for d in range(most):
        free = durable(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(d)))
        if free.isEmpty():
            break
        placed = durable(placed.unionByName(free))
        rest = durable(rest.join(free.select("node"), "node", "left_anti"))
        left = durable(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    return nodes.join(placed, "node", "left")


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """path (array of nodes, the smallest first): every cycle of at most ``most`` nodes, once."""
    e = durable(edges.where("src <> dst").select("src", "dst").distinct())
    walk = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("src"))
    out = None
    for n in range(2, most + 1):
        step = walk.join(e, "src")
        closed = step.where(F.col("dst") == F.col("path")[0]).select("path")
        out = closed if out is None else out.unionByName(closed)
        if n < most:
            on = step.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst")))
            walk = durable(on.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src")))
    return out
