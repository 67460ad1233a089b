"""Connected components by union-find.

Each task first runs union-find over its own edges and keeps only stars (node, root); then rounds of
large-star and small-star steps over the whole graph bring every node to the smallest node of its
component. Aggregations combine before they shuffle, and no neighbourhood is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed


class UnionFind:
    """Union by smaller number, with path halving."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = UnionFind()

    def stars() -> pa.RecordBatch:
        rows = [(x, found.find(x)) for x in found.parent]
        pairs = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.union(a, b)
        if len(found.parent) > 1_000_000:
            yield stars()
            found = UnionFind()
    yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).repartition("m", "w")
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m").repartition("m", "w")
    across = down.join(least, F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of the edges u, v (long, not null)
    that isn't its own component; the other nodes are left out."""
    now = checkpointed(edges.filter("u != v").mapInArrow(_local_stars, "u long, v long"))
    while True:
        # done when every node has one edge, to a node that has none
        again = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        inner = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi")
        if again.unionByName(inner).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = checkpointed(_small_star(_large_star(now)))
