"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import cut_lineage, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its larger (or its smaller and own) neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    turned = both.join(least, "a")
    if large:
        moved = turned.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        moved = turned.where("b <= a").select(F.col("m").alias("a"), "b").unionByName(least.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected edges ``a, b``: its component's smallest node.

    Rows with a null end or two equal ends are no edges.  The steps need a number of rounds that grows with the
    logarithm of the longest path.  Each round's edges go to the checkpoint folder; only counts reach the driver.
    """
    now = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
        last, now = now, cut_lineage(_star(_star(now, True), False))
        forget(last)
    leaves = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return leaves.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
