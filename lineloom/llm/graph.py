"""Connected components by alternating large and small stars.

Every round rewires edges towards the smallest node of each neighbourhood; tables are written
to the shared folder between rounds, so lineage stays short. Hubs cost one pre-aggregated
minimum and joins whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import drop_spool, spool


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (a, b), a > b. Links each node's neighbours (small star: the lesser ones and the
    node itself; large star: the greater ones) to the least node around it."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("other")).join(least.withColumnRenamed("a", "node"), "node").select(F.col("other").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) of every node of edges (a, b), both bigint."""
    edges = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        last, edges = edges, spool(_star(_star(edges, small=False), small=True), "edges")
        drop_spool(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
