"""Connected components of an edge table, by label passing and pointer jumping on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from swellworks.llm.runtime import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, label): the smallest node reachable from every node that has an edge.  ``edges`` has long a, b.

    Each round takes the least label among a node's neighbours (partial minima before the shuffle) and then the
    label of that label.  Only what moved in the round before is passed on, and only labels that have a lesser one are looked up:
    both are the small sides of joins with unique keys, which Spark broadcasts where their size allows; else it splits the
    partitions of a node or label that many rows carry.  Rows with a null end, loops and repeated rows count for nothing; no
    edges, no rows.  Ends when nothing moves; nothing but that reaches the driver.
    """
    both = edges.where("a <> b").select("a", "b")
    links = ws.table(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_links")
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels, i = ws.table(nodes.select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), f"{name}_0"), 0
    while not labels.where("moved").isEmpty():
        i += 1
        news = labels.where("moved").select(F.col("node").alias("b"), "label")
        near = links.join(news, "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        every = near.union(labels.select("node", "label", F.col("label").alias("own")))
        least = ws.table(every.groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own")), f"{name}_{i}m")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("top")).where("top < label")
        now = F.coalesce("top", "label")
        labels = ws.table(least.join(up, "label", "left").select("node", now.alias("label"), (now < F.col("own")).alias("moved")), f"{name}_{i}")
        ws.drop(f"{name}_{i}m", f"{name}_{i - 1}")
    return labels.drop("moved")
