"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_within

#: Edges that one task may union by itself: 16 bytes each, and about 200 a vertex for union-find.
ONE_TASK = 500_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(v, label): for each end of an edge (a, b), two longs, the least vertex that it reaches.

    Few edges (a checked count) are united by union-find in one task on an executor; beyond that,
    large-star and small-star steps contract the graph in a logarithmic number of rounds, each of
    them joins and minima over all partitions. Both give the same labels.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if rows_within(edges, one_task):
        return edges.coalesce(1).mapInArrow(_union_find, "v long, label long")
    return _stars(edges)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    vertices = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(map(find, vertices), pa.int64())], ["v", "label"])


def _stars(edges: DataFrame) -> DataFrame:
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    while True:
        # large star: every neighbour above u goes to the least of u and its neighbours
        wide = both(edges)
        least = wide.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = wide.join(least, wide["a"] == least["u"]).where("b > a").select("b", "m").distinct().select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).where("a <> b")
        large = checkpointed(large)
        # small star: u and its neighbours below go to the least of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.join(low, large["b"] == low["u"])
        small = joined.select("a", "m").unionByName(low.select(F.col("u").alias("a"), "m")).where("a <> m").distinct()
        small = checkpointed(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    stars = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("v"), "label").distinct())
