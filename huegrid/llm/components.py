"""Connected components of a table of links, without collecting them.

Each round first contracts a task's links, HELD at a time, to stars (union-find),
then applies a large-star and a small-star step; rounds end when all links are
stars around the smallest node.  Every round is a written table.  A hub is one
key of joins whose other side has one row for it, so Spark splits it by skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, staged

_EDGE = "node long, root long"


def forest(pairs) -> dict[int, int]:
    """The smallest member of its component for each node of some pairs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


#: Links that one contraction holds at once.
HELD = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        found = [(x, r) for x, r in forest(pairs).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["node", "root"])

    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        if len(held) >= HELD:
            yield stars(held)
            held = []
    yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """links: two long columns. Returns node, root for every node that is not the smallest of its component."""
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node != root")
    edges = staged(edges.mapInArrow(lean(_contract), _EDGE).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        # nothing to do once each node has one root and no root is a node
        odd = edges.groupBy("node").count().where("count > 1").select("node").unionByName(edges.join(edges.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select("node"))
        if odd.isEmpty():
            return edges
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node != root")
        large = staged(large.distinct(), "large")
        first = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(first, "node").select(F.explode(F.array(F.struct("node", "least"), F.struct(F.col("root").alias("node"), "least"))).alias("e"))
        small = small.select("e.node", F.col("e.least").alias("root")).where("node != root")
        before, edges = edges, staged(small.mapInArrow(lean(_contract), _EDGE).distinct(), "small")
        discard(before, large)
