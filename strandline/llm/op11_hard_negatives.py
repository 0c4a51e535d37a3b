"""Hard-negative mining: exact inner products behind a PCA rotation.

1. Vectors become whole numbers, and an orthogonal rotation is fitted on a sample so that leading
   components carry most of their weight. A rotation leaves inner products as they are.
2. Anchors go to every task in blocks. A task takes its rows in slices: of each pair it adds up the
   products of the leading components, a stage of components at a time. What the components left
   over can add is at most the product of their norms, and a slack for rounding: pairs that cannot
   reach what the anchor still looks for are discarded there, whole rows as soon as no anchor
   wants them.
3. The pairs that are left are settled by the inner product of their whole numbers.
4. The first sweep finds each anchor's positives. Their scores span the windows of the second, which
   finds the best rows of other labels inside each window. Tasks give their best rows for each
   anchor, Spark ranks them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, staged, table
from .vectors import QUERIES, SAMPLE, Best, blocks, dimension, finite, matrix, one_per_id, sampled

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's must lie.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows and anchors whose pairs are held together, and pairs that are multiplied out together.
ROWS, ANCHORS, PAIRS = 4_096, 512, 65_536
#: Parts of a vector after which a pair can be discarded.
STAGES = 4

Anchors = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, whole vectors


def rotation(sample: np.ndarray) -> np.ndarray:
    """The principal axes of the sample's second moments as columns, the heaviest first."""
    if not len(sample):
        return np.eye(sample.shape[1])
    scale = np.abs(sample).max() or 1.0
    _, axes = np.linalg.eigh((sample / scale).T @ (sample / scale))
    return axes[:, ::-1].copy()


class Rotated:
    """Whole vectors with their rotated components, and the norm of what follows each stage."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.whole = vectors.astype(np.int64)
        self.parts = vectors @ axes
        d = vectors.shape[1]
        self.cuts = sorted({-(-d * k // STAGES) for k in range(1, STAGES + 1)})
        left = np.cumsum((self.parts**2)[:, ::-1], axis=1)[:, ::-1]
        self.rests = [np.sqrt(left[:, c]) if c < d else np.zeros(len(vectors)) for c in self.cuts]
        self.norms = np.sqrt((vectors**2).sum(1))

    def take(self, rows: np.ndarray | slice) -> Rotated:
        out = object.__new__(Rotated)
        out.whole, out.parts, out.cuts, out.norms = self.whole[rows], self.parts[rows], self.cuts, self.norms[rows]
        out.rests = [r[rows] for r in self.rests]
        return out


def survivors(rows: Rotated, anchors: Rotated, least: np.ndarray, most: np.ndarray | None, apart: np.ndarray | None, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, exact product) of all pairs that may lie between least and most of the anchor.

    apart: a mask of the pairs that count at all. slack: the error of a partial product and its bound,
    as a part of the product of the norms.
    """
    at = np.arange(len(rows.norms))
    total, begun = np.zeros((len(at), len(anchors.norms))), 0
    allowed = np.ones(total.shape, bool) if apart is None else apart
    for cut, rest_r, rest_a in zip(rows.cuts, rows.rests, anchors.rests):
        total += rows.parts[at, begun:cut] @ anchors.parts[:, begun:cut].T
        margin = rest_r[at, None] * rest_a
        margin += slack * rows.norms[at, None] * anchors.norms + slack
        allowed = allowed & (total + margin >= least)
        if most is not None:
            allowed &= total - margin <= most
        wanted = allowed.any(1)
        if not wanted.any():
            return
        if not wanted.all():
            at, total, allowed = at[wanted], total[wanted], allowed[wanted]
        begun = cut
    r, a = np.nonzero(allowed)
    for k in range(0, len(r), PAIRS):
        i, j = at[r[k : k + PAIRS]], a[k : k + PAIRS]
        yield i, j, (rows.whole[i] * anchors.whole[j]).sum(1)


def _pieces(batches: Iterator[pa.RecordBatch], dim: int, axes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Rotated]]:
    """Ids, labels and vectors of a task's rows; the first slices are small, until something is found to measure by."""
    size = 256
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            at, size = at + part.num_rows, min(2 * size, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), Rotated(matrix(part.column(2), dim), axes)


def _slack(axes: np.ndarray) -> float:
    d = len(axes)
    return 8 * d * d * 2.0**-53 + 4 * float(np.abs(axes.T @ axes - np.eye(d)).sum())


def positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, axes: np.ndarray, k: int) -> Best:
    """Of a task's rows, each anchor's k best others of its label."""
    ids, labels, vectors = anchors
    best, turned, slack = Best(len(ids), k, np.int64), Rotated(vectors, axes), _slack(axes)
    groups = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}
    for row_ids, row_labels, rows in _pieces(batches, vectors.shape[1], axes):
        for label in np.unique(row_labels):
            own = groups.get(int(label))
            if own is None:
                continue
            mine = np.flatnonzero(row_labels == label)
            some = rows.take(mine)
            for a in range(0, len(own), ANCHORS):
                few = own[a : a + ANCHORS]
                others = row_ids[mine][:, None] != ids[few]
                least = np.where(best.filled[few, -1], best.worst()[few], -np.inf)
                for i, j, score in survivors(some, turned.take(few), least, None, others, slack):
                    good = score >= best.worst()[few[j]]
                    best.offer(few[j[good]], score[good], row_ids[mine[i[good]]])
    return best


def negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, low: np.ndarray, high: np.ndarray, axes: np.ndarray, k: int) -> Best:
    """Of a task's rows, the k best of another label inside each window.

    low, high: for each anchor its windows, from low to high, both included; one without numbers has
    low above high. The groups of the result are the windows, anchor by anchor.
    """
    ids, labels, vectors = anchors
    width = low.shape[1]
    best, turned, slack = Best(low.size, k, np.int64), Rotated(vectors, axes), _slack(axes)
    real = low <= high
    some = np.flatnonzero(real.any(1))
    most = np.where(real, high, np.iinfo(np.int64).min).max(1) if width else np.empty(0)
    for row_ids, row_labels, rows in _pieces(batches, vectors.shape[1], axes):
        for a in range(0, len(some), ANCHORS):
            few = some[a : a + ANCHORS]
            need = np.where(best.filled[:, -1], best.worst(), low.ravel()).reshape(low.shape)[few]
            need = np.maximum(need, low[few])
            least = np.where(real[few], need, np.iinfo(np.int64).max).min(1).astype(np.float64)
            for i, j, score in survivors(rows, turned.take(few), least, most[few].astype(np.float64), row_labels[:, None] != labels[few], slack):
                at, w = np.nonzero((score[:, None] >= need[j]) & (score[:, None] <= high[few][j]) & real[few][j])
                best.offer(few[j[at]] * width + w, score[at], row_ids[i[at]])
    return best


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that take part, with whole components, and the dimension."""
    dim = dimension(df, vec_col)
    limit = math.isqrt((2**63 - 1) // max(dim, 1))
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector"))
    own = own.where(F.col("label").isNotNull() & finite("vector", dim))
    own = own.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("double")))
    return one_per_id(own.where(F.forall("vector", lambda x: F.abs(x) <= min(limit, 2**53))), "whole"), dim


def hard_negatives(
    df: DataFrame, anchors: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = QUERIES, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id a table of anchors (vec_id) names, else those with ids divisible by
    every. A negative's score lies between low and high percent of the positive's.

    Rows without an id, a label or a vector take no part, nor do vectors with a null or a number that is
    not finite, with another length than the commonest (of equals the largest), or with a component so
    large that products would leave 64 bits (about 2^20 before scaling). Rows that repeat an id are one
    row: the one with the least label, then the least vector. An anchor without positives gives no rows,
    nor does a positive without negatives, one with a score below zero among them. Ties go by the smaller id. Other
    columns are ignored, whatever their names; an empty table gives no rows. sample: rows for the rotation.
    """
    spark = df.sparkSession
    rows, dim = usable(df, id_col, vec_col, label_col)
    n = rows.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    axes = rotation(matrix(sampled(rows, n, sample)["vector"], dim))
    wanted = rows.where(F.col("vec_id") % every == 0) if anchors is None else rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi")
    near = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    hard = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = []
    for part in blocks(wanted, block):
        own = (part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["vector"], dim))
        shared = spark.sparkContext.broadcast((own, axes))  # a block's vectors

        def first(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, axes = shared.value
            group, score, ids = positives(batches, own, axes, n_positives).rows()
            yield pa.RecordBatch.from_arrays([pa.array(own[0][group]), pa.array(ids), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

        best = rows.mapInArrow(freeing(first), "anchor_id long, positive_id long, positive_score long")
        best = staged(best.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= n_positives).drop("_rank"), "positives")
        got = best.select("anchor_id", "positive_score").distinct().toArrow()  # a block's anchors, few for each
        place = {int(x): k for k, x in enumerate(own[0])}
        lows, highs, taken = np.ones((len(own[0]), n_positives), np.int64), np.zeros((len(own[0]), n_positives), np.int64), np.zeros(len(own[0]), np.int64)
        scores = np.zeros_like(lows)
        for anchor, score in zip(got["anchor_id"].to_pylist(), got["positive_score"].to_pylist()):
            k = place[anchor]
            lows[k, taken[k]], highs[k, taken[k]], scores[k, taken[k]] = -(-low * score // 100), high * score // 100, score
            taken[k] += 1
        windows = spark.sparkContext.broadcast((lows, highs, scores))

        def second(batches: Iterator[pa.RecordBatch], shared=shared, windows=windows) -> Iterator[pa.RecordBatch]:
            own, axes = shared.value
            lows, highs, scores = windows.value
            group, score, ids = negatives(batches, own, lows, highs, axes, n_negatives).rows()
            yield pa.RecordBatch.from_arrays([pa.array(own[0][group // lows.shape[1]]), pa.array(scores.ravel()[group]), pa.array(ids), pa.array(score)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

        mined = rows.mapInArrow(freeing(second), "anchor_id long, positive_score long, negative_id long, negative_score long")
        mined = mined.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= n_negatives)
        found.append(staged(best.join(mined, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        shared.unpersist()
        windows.unpersist()
    out = spark.createDataFrame([], schema)
    for f in found:
        out = out.unionByName(f)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are wrong by one at first, as the contract has it."""
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.select("vec_id", "embedding", label.alias("label")))


SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM whole a, whole r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
mined AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10
"""
