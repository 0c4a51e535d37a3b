"""What the vector searches share: the rows that take part, samples, blocks of queries, running bests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Queries that one pass over all rows carries: so many vectors are held by each task.
QUERIES = 8_192
#: Rows that a model is fitted on, about: those whose hashes are least.
SAMPLE = 32_768


def dimension(df: DataFrame, vec_col: str) -> int:
    """The commonest length of the vectors, of equals the largest; 0 if there are none."""
    lengths = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = lengths.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def finite(vec_col: str, dim: int):
    """True for a vector of dim finite numbers."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above all numbers here
    return F.coalesce((F.size(vec_col) == dim) & good, F.lit(False))


def one_per_id(df: DataFrame, name: str) -> DataFrame:
    """df(vec_id, ...), written and read again with one row for each id: the least of those that repeat it."""
    rest = [c for c in df.columns if c != "vec_id"]
    least = df.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return staged(least.select("vec_id", *(F.col("_row")[c].alias(c) for c in rest)), name)


def sampled(df: DataFrame, n: int, most: int = SAMPLE) -> pa.Table:
    """About most of the n rows, the same ones each time; all rows if there are fewer."""
    if n > most:
        df = df.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return df.toArrow()


def blocks(queries: DataFrame, most: int = QUERIES) -> Iterator[pa.Table]:
    """The queries in blocks of about most rows, each fit for a broadcast."""
    n = queries.count()
    parts = -(-n // most)
    if parts <= 1:
        if n:
            yield queries.toArrow()
        return
    held = staged(queries.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))), "queries")
    for k in range(parts):
        block = held.where(F.col("_part") == k).drop("_part").toArrow()
        if block.num_rows:
            yield block


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of an Arrow column of lists, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # of no chunks
            return np.empty((0, dim))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Best:
    """The k best (score, id) of each group so far: higher scores first, of equals the smaller id."""

    def __init__(self, groups: int, k: int, kind: type):
        self.lowest = np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.scores = np.full((groups, k), self.lowest, kind)
        self.ids = np.zeros((groups, k), np.int64)
        self.filled = np.zeros((groups, k), bool)

    def worst(self) -> np.ndarray:
        """What a score must reach to be among the k best of its group."""
        return self.scores[:, -1]

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        held = self.filled[touched]
        g = np.concatenate([group, np.repeat(touched, held.sum(1))])
        s = np.concatenate([score, self.scores[touched][held]])
        i = np.concatenate([ids, self.ids[touched][held]])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        top = rank < self.scores.shape[1]
        g, rank = g[top], rank[top]
        self.scores[g, rank], self.ids[g, rank], self.filled[g, rank] = s[top], i[top], True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, scores and ids of all that is held."""
        group, _ = np.nonzero(self.filled)
        return group, self.scores[self.filled], self.ids[self.filled]
