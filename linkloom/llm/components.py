"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored, stored_counting


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in `links` (a, b).

    Each round hangs every node below its smallest neighbour, follows these
    trees to their roots by doubling, and replaces links by links of roots.
    Rounds are written to the shared folder; only counts reach the driver.
    """
    edges, left = stored_counting(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        trees = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "trees")
        moved = 1
        while moved:
            up = trees.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher, moved = stored_counting(trees.join(up, "root").selectExpr("node", "above as root", "above <> root as moved"), "trees", "moved")
            trees = higher.select("node", "root")
        if labels is None:
            labels = trees
        else:
            up = trees.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = stored(labels.join(up, "root", "left").selectExpr("node", "coalesce(above, root) as root"), "labels")
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(trees.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        edges, left = stored_counting(ends.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
