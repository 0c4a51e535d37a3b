"""Calibration, benchmark scores, gates, comparability and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import precision_recall
from .store import numbered

#: Tolerated loss of each metric, and the metrics where less is better.
TOLERANCES = {"precision": 0.02, "recall": 0.02, "false_new_rate": 0.02, "coverage": 0.02, "lineage.purity": 0.05, "lineage.multi_version_recovery": 0.05}
LOWER_IS_BETTER = {
    "false_new_rate", "lineage.fragmentation", "lineage.fragmentation_unlinked", "lineage.wrong_merge", "lineage.wrong_split_unlinked", "lineage.false_resurrection_candidates",
}
#: Points that a calibration needs to count, and digits of its shares.
MIN_SAMPLES, DIGITS = 30, 4


def pooled(points: DataFrame, group: list[str], score: str = "score", ok: str = "ok", digits: int | None = DIGITS) -> DataFrame:
    """Blocks (upper, precision, n) of the best rising step function, by pooling adjacent violators.

    Points are ordered by (score, ok) and ties are not pooled beforehand; blocks are pooled only where
    the share falls, so neighbours with the same share stay apart, single points too. Each group is one
    calibration profile; only the numbers of equal (score, ok) travel to the task that pools it, and
    blocks that are alike are multiplied afterwards.
    """
    counted = points.groupBy(*group, F.col(score).alias("score"), F.col(ok).cast("int").alias("ok")).agg(F.count(F.lit(1)).alias("n"))

    def pool(pdf):
        import pandas as pd

        blocks: list[list] = []  # sum, count, upper, how many such blocks stand side by side
        for s, k, n in pdf.sort_values(["score", "ok"])[["score", "ok", "n"]].itertuples(index=False):
            total, size, copies = (0, n, 1) if not k and blocks and blocks[-1][0] else (k, 1, n)  # misses fall into a block with hits, one by one
            while blocks and blocks[-1][0] * size > total * blocks[-1][1]:
                last = blocks.pop()
                total, size = total + last[0] * last[3], size + last[1] * last[3]
            blocks.append([total, size, s, copies])
        head = {g: pdf[g].iloc[0] for g in group}
        share = lambda b: b[0] / b[1] if digits is None else round(b[0] / b[1], digits)
        return pd.DataFrame([{**head, "upper": float(b[2]), "precision": share(b), "n": int(b[1]), "copies": int(b[3])} for b in blocks])

    kinds = ", ".join(f"{g} {counted.schema[g].dataType.simpleString()}" for g in group)
    out = counted.groupBy(*group).applyInPandas(pool, f"{kinds}, upper double, precision double, n long, copies long")
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_c", "copies")


def fitted(points: DataFrame, group: list[str], split: str, least: int = MIN_SAMPLES) -> DataFrame:
    """Calibration profiles: group, mapping (rising), n, validated. Only the calibration split may be fitted on."""
    if split != "calibration":
        raise ValueError("a calibration is fitted on the calibration split only")
    blocks = pooled(points, group)
    out = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("upper", "precision", "n"))).alias("mapping"), F.sum("n").alias("n"))
    return out.withColumn("validated", F.col("n") >= least)


def reliability(points: DataFrame, bins: int = 10, score: str = "score", ok: str = "ok") -> DataFrame:
    """Equal bins with counts and shares; the last one holds 1.0 too, scores beyond are in none."""
    spark = points.sparkSession
    inside = points.where((F.col(score) >= 0) & (F.col(score) <= 1))
    own = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    got = inside.groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("good"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))


def displayed(scores: DataFrame, profiles: DataFrame, abstain: bool = False) -> DataFrame:
    """State, probability and abstention of raw scores (engine, context, score).

    profiles: engine, context, validated, created, mapping (array of struct upper, precision, n, rising).
    CALIBRATED needs a score and a validated profile of the same engine and context, of which the newest
    counts; OUT_OF_DISTRIBUTION is an engine that has any profile, validated or not; UNCALIBRATED one
    without. With `abstain`, what is out of distribution abstains.
    """
    engines = profiles.select("engine").distinct().withColumn("known", F.lit(True))
    newest = profiles.where("validated").groupBy("engine", "context").agg(F.max_by("mapping", F.struct("created", F.to_json("mapping"))).alias("mapping"))
    out = scores.join(newest, ["engine", "context"], "left").join(engines, "engine", "left")
    step = F.coalesce(F.get(F.filter("mapping", lambda b: F.col("score") <= b["upper"]), F.lit(0)), F.element_at("mapping", -1))
    there = F.col("mapping").isNotNull() & F.col("score").isNotNull()
    state = F.when(there, "CALIBRATED").when(F.col("known"), "OUT_OF_DISTRIBUTION").otherwise("UNCALIBRATED")
    out = out.withColumn("state", state)
    return out.select("engine", "context", "score", "state", F.when(there, step["precision"]).alias("probability"), ((F.col("state") == "OUT_OF_DISTRIBUTION") & abstain).alias("abstain"))


def transition_scores(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of predicted pairs (key, left, right).

    truth: key, left, right, required. Acceptable pairs (splits, merges) are never false, and only
    required ones can be missed.
    """
    pair = [*key, "left", "right"]
    both = predicted.select(*pair).distinct().withColumn("p", F.lit(1)).join(truth.select(*pair, "required").withColumn("t", F.lit(1)), pair, "full_outer")
    p, t = F.col("p").isNotNull(), F.col("t").isNotNull()
    out = both.groupBy(*key).agg(F.count_if(p & t & F.col("required")).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t & F.col("required")).alias("fn"))
    precision, recall, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": f1})


def split_by_parity(steps: DataFrame, *order: str) -> DataFrame:
    """Calibration and test steps in turn, in the order of the distinct steps, which are numbered range by range."""
    places = numbered(steps.select(*order).distinct(), *order, name="_place")
    out = steps.join(places, list(order))
    return out.withColumn("split", F.when(F.col("_place") % 2 == 1, "calibration").otherwise("test")).drop("_place")


def gates(current: DataFrame, baseline: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """Each metric of the baseline that has a tolerance: ok unless it lost more than that.

    Both frames: metric, value. A metric without a current value fails; one without a baseline is
    skipped.
    """
    spark = current.sparkSession
    limits = spark.createDataFrame([(k, v, k in LOWER_IS_BETTER) for k, v in sorted((tolerances or TOLERANCES).items())], "metric string, tolerance double, lower boolean")
    out = baseline.where("value IS NOT NULL").select("metric", F.col("value").alias("baseline")).join(limits, "metric").join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    lost = F.when(F.col("lower"), F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    return out.select("metric", "baseline", "current", "tolerance", F.coalesce(lost <= F.col("tolerance"), F.lit(False)).alias("ok"))


def comparability(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """FULL if two runs have the same set of signatures, PARTIAL if they share one, else NONE.

    runs: run, signature; pairs: a, b. Signatures are counted by joins, not gathered.
    """
    own = runs.select("run", "signature").distinct()
    size = own.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.join(own.withColumnRenamed("run", "a"), "a").join(own.withColumnRenamed("run", "b"), ["b", "signature"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").join(size.select(F.col("run").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b", "left")
    s = F.coalesce("shared", F.lit(0))
    return out.withColumn("comparability", F.when((s == F.col("na")) & (s == F.col("nb")), "FULL").when(s > 0, "PARTIAL").otherwise("NONE")).drop("shared", "na", "nb")


def capacity_class(builds: Column, functions: Column) -> Column:
    """The first class whose limits hold both numbers; beyond all of them XL."""
    return F.when((builds <= 25) & (functions <= 50_000), "S").when((builds <= 250) & (functions <= 1_000_000), "M").when((builds <= 2500) & (functions <= 10_000_000), "L").otherwise("XL")


def validated_capacity(name: Column) -> Column:
    """Only for S and M are times published."""
    return name.isin("S", "M")
