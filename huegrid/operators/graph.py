"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._stage import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links: two columns of one comparable type. Returns node, root (the least of its component) for every node but the roots.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    least it knows, and is checkpointed; rounds end when every node has one
    root and no root is a node.
    """
    a, b = links.columns
    edges = checkpointed(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct())
    while True:
        roots = edges.select(F.col("root").alias("node")).distinct()
        odd = edges.groupBy("node").count().where("count > 1").select("node").unionByName(edges.join(roots, "node", "left_semi").select("node"))
        if odd.isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        first = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(first, "node").select(F.explode(F.array(F.struct("node", "least"), F.struct(F.col("root").alias("node"), "least"))).alias("e"))
        edges = checkpointed(small.select("e.node", F.col("e.least").alias("root")).where("node <> root").distinct())
