"""Nearest vectors: an inverted file of coarse centroids with product-quantised residuals, and exact scores.

1. Coarse centroids and, for each pair of components, a codebook of residuals are fitted on a sample
   of the unit vectors.
2. Every row is indexed where it lies: its list, its residual's codes and the length of what the
   codes leave out. Within a file rows are sorted by list, so that each file is an inverted file of
   its own rows. No list has to meet in one task, however many rows it has.
3. Queries come in blocks. The first sweep reads only the lists nearest to each query; tables of
   the query's products with the codewords give each row a score, and the length left out says how
   far off it may be. Rows that may be among the best are scored on the original vectors.
4. The best so far are a bound for the second sweep over all other lists: a list whose cone cannot
   reach it is skipped, as are rows whose table score and length left out fall short. So nothing is
   lost: the result is that of a comparison with every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, staged, table
from .vectors import QUERIES, SAMPLE, Best, blocks, dimension, finite, matrix, one_per_id, sampled

NEAREST = 5
#: Lists that the first sweep reads for each query; it only sets the pace of the second.
PROBES = 8
MOST_LISTS, CODES, ROUNDS = 1_024, 256, 8
#: Queries and rows that are compared together, and pairs that are scored exactly together.
GROUP, ROWS, PAIRS = 128, 1_024, 32_768
#: Error of scores that single-precision tables give: 80 terms, whose sizes sum to less than 4.
ROUNDING = 2e-5


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # for each part: (codewords, components)
    parts: list[slice]
    reach: np.ndarray | None = None  # for each list the least cosine of a row with the centroid's direction


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is about one: cosines stay exactly
    as they are, and no square leaves the range."""
    _, power = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -power[:, None])


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.empty(0, np.int64), *((vectors[k : k + 8192] @ centres.T - half).argmax(1) for k in range(0, len(vectors), 8192))])


def centres(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of k groups at most, by Lloyd's rounds from vectors drawn at random."""
    k = min(k, len(vectors))
    out = vectors[np.random.default_rng(seed).permutation(len(vectors))[:k]].copy()
    for _ in range(rounds):
        of = nearest(vectors, out)
        order = np.argsort(of, kind="stable")
        own, begin = np.unique(of[order], return_index=True)  # a centre without vectors stays where it is
        out[own] = np.add.reduceat(vectors[order], begin, axis=0) / np.diff(np.append(begin, len(of)))[:, None]
    return out


def fitted(sample: np.ndarray, lists: int) -> Index:
    """Centroids and codebooks from a sample of unit vectors."""
    coarse = centres(sample, lists)
    rest = sample - coarse[nearest(sample, coarse)]
    d = sample.shape[1]
    parts = [slice(k, min(k + 2, d)) for k in range(0, d, 2)]
    return Index(coarse, [centres(rest[:, p], CODES) for p in parts], parts)


def encoded(unit: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and length left out of unit vectors."""
    of = nearest(unit, index.centroids)
    rest = unit - index.centroids[of]
    codes = np.empty((len(unit), len(index.parts)), np.uint8)
    for m, (p, book) in enumerate(zip(index.parts, index.books)):
        codes[:, m] = nearest(rest[:, p], book)
        rest[:, p] -= book[codes[:, m]]
    return of, codes, np.sqrt((rest * rest).sum(1))


def search(batches: Iterator[pa.RecordBatch], index: Index, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, again: bool, k: int, probes: int) -> Best:
    """The k best of a task's rows for each query, among those that reach its bound.

    Batches: vec_id, vector, list, codes, left out, by list. again: leave out the lists that the first
    sweep has read, and those that cannot reach the bound.
    """
    best = Best(len(query_ids), k, np.float64)
    queries = scaled(queries)
    unit = units(queries)
    length = np.sqrt((queries * queries).sum(1))
    coarse = unit @ index.centroids.T
    wanted = np.zeros(coarse.shape, bool)
    n = min(probes, coarse.shape[1])
    np.put_along_axis(wanted, np.argpartition(-coarse, n - 1, axis=1)[:, :n], True, axis=1)
    if again:
        size = np.sqrt((index.centroids**2).sum(1))
        cosine = np.clip(coarse / np.where(size > 0, size, 1), -1, 1)
        gap = np.maximum(np.arccos(cosine) - np.arccos(np.clip(index.reach, -1, 1)), 0)
        wanted = ~wanted & ((np.cos(gap) + 1e-7 >= bound[:, None]) | (size == 0))
    order = np.argsort(coarse.argmax(1), kind="stable")  # queries of a group look into much the same lists
    groups = [order[a : a + GROUP] for a in range(0, len(order), GROUP)]
    tables = [[np.ascontiguousarray((unit[g][:, p] @ book.T).T.astype(np.float32)) for p, book in zip(index.parts, index.books)] for g in groups]
    dim = queries.shape[1]
    for batch in batches:
        ids, vectors, lists = batch.column(0).to_numpy(), scaled(matrix(batch.column(1), dim)), batch.column(2).to_numpy()
        codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), len(index.parts))
        left = batch.column(4).to_numpy().astype(np.float32)
        lengths = np.sqrt((vectors * vectors).sum(1))
        begins = np.flatnonzero(np.diff(lists, prepend=-1))
        for begin, end in zip(begins, np.append(begins[1:], len(ids))):
            looking = wanted[:, lists[begin]]
            if not looking.any():
                continue
            for g, of in zip(groups, tables):
                cols = np.flatnonzero(looking[g])
                if not len(cols):
                    continue
                for a in range(begin, end, ROWS):
                    rows = slice(a, min(a + ROWS, end))
                    near = of[0][codes[rows, 0]]
                    for m in range(1, len(of)):
                        near += of[m][codes[rows, m]]
                    few = g[cols]
                    near = near[:, cols] + coarse[few, lists[begin]].astype(np.float32) + left[rows, None]
                    near += ROUNDING
                    _scored(best, near, few, rows.start, ids, vectors, lengths, query_ids, queries, length, bound)
    return best


def _scored(best: Best, near: np.ndarray, few: np.ndarray, begin: int, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, length: np.ndarray, bound: np.ndarray) -> None:
    """Score the pairs whose upper bounds (near) reach what their queries have; those likeliest to raise it first."""
    k = best.scores.shape[1]
    need = np.maximum(bound[few], best.worst()[few])
    if len(near) > 4 * k and not np.isfinite(need).all():
        top = np.argpartition(-near, k, axis=0)[:k]
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, top, True, axis=0)
        _exact(best, first, few, begin, ids, vectors, lengths, query_ids, queries, length, bound)
        need = np.maximum(bound[few], best.worst()[few])
        _exact(best, (near >= need) & ~first, few, begin, ids, vectors, lengths, query_ids, queries, length, bound)
    else:
        _exact(best, near >= need, few, begin, ids, vectors, lengths, query_ids, queries, length, bound)


def _exact(best: Best, pairs: np.ndarray, few: np.ndarray, begin: int, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, length: np.ndarray, bound: np.ndarray) -> None:
    r, c = np.nonzero(pairs)
    for a in range(0, len(r), PAIRS):
        i, j = r[a : a + PAIRS] + begin, few[c[a : a + PAIRS]]
        score = (vectors[i] * queries[j]).sum(1) / (lengths[i] * length[j])
        good = (score >= np.maximum(bound[j], best.worst()[j])) & (ids[i] != query_ids[j])
        best.offer(j[good], score[good], ids[i[good]])


def build_index(rows: DataFrame, n: int, dim: int, sample: int = SAMPLE, lists: int | None = None) -> tuple[DataFrame, Index]:
    """The indexed rows (vec_id, vector, list, codes, left, cosine), sorted by list in each file, and the index."""
    unit = units(scaled(matrix(sampled(rows, n, sample)["vector"], dim)))
    index = fitted(unit, lists or int(np.clip(np.sqrt(n) / 2, 1, MOST_LISTS)))
    shared = rows.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids and the codebooks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(scaled(matrix(batch.column(1), dim)))
            of, codes, left = encoded(unit, shared.value)
            c = shared.value.centroids[of]
            size = np.sqrt((c * c).sum(1))
            cosine = (unit * c).sum(1) / np.where(size > 0, size, 1)
            columns = [batch.column(0), batch.column(1), pa.array(of, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(left), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "list", "codes", "left", "cosine"])

    kind = rows.schema["vector"].dataType.simpleString()
    held = rows.mapInArrow(freeing(run), f"vec_id long, vector {kind}, list int, codes binary, left double, cosine double")
    held = staged(held.sortWithinPartitions("list"), "inverted")
    cones = held.groupBy("list").agg(F.min("cosine").alias("least")).toArrow()  # a row for each list
    index.reach = np.ones(len(index.centroids))
    index.reach[cones["list"].to_numpy()] = cones["least"].to_numpy()
    return held, index


def nearest_vectors(
    df: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = NEAREST,
    probes: int = PROBES, lists: int | None = None, block: int = QUERIES, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest cosine with each query but the query's own.

    Queries are the rows whose id a table of queries (vec_id) names, else those with ids divisible by
    every. Rows without an id take no part, nor do vectors that are null, zero, hold a null or a number
    that is not finite, or have another length than the commonest (of equals the largest). Rows that
    repeat an id are one row: the one with the least vector. Ties go by the smaller id. Other columns are
    ignored, whatever their names; an empty table gives no rows. sample: rows that the index is fitted
    on; lists: how many, by default half the root of the rows, 1,024 at most.
    """
    spark = df.sparkSession
    dim = dimension(df, vec_col)
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    rows = one_per_id(own.where(finite("vector", dim) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    held, index = build_index(rows, n, dim, sample, lists)
    wanted = rows.where(F.col("vec_id") % every == 0) if queries is None else rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def sweep(ids: np.ndarray, shared, again: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, vectors, bound = shared.value
            group, score, found = search(batches, index, ids, vectors, bound, again, k, probes).rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[group]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        return held.mapInArrow(freeing(run), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.select("query_id", "vec_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)

    out = spark.createDataFrame([], schema)
    for part in blocks(wanted, block):
        ids, vectors = part["vec_id"].to_numpy(), matrix(part["vector"], dim)
        shared = spark.sparkContext.broadcast((index, vectors, np.full(len(ids), -np.inf)))  # a block's vectors
        first = staged(ranked(sweep(ids, shared, False)), "probed")
        full = first.where(F.col("rank") == k).select("query_id", "score").toArrow()  # a number for each query of the block
        bound = np.full(len(ids), -np.inf)
        place = np.argsort(ids)
        bound[place[np.searchsorted(ids[place], full["query_id"].to_numpy())]] = full["score"].to_numpy()
        closer = spark.sparkContext.broadcast((index, vectors, bound))
        rest = sweep(ids, closer, True)
        result = staged(ranked(first.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score"), "nearest")
        shared.unpersist()
        closer.unpersist()
        out = out.unionByName(result)
    return out


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e) / (sqrt(list_inner_product(r.e, r.e)) * sqrt(list_inner_product(q.e, q.e))) AS score
  FROM v q, v r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
