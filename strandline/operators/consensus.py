"""Consensus of several matchers by evidence families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import strength

#: All families of evidence, in the order in which missing ones are named.
FAMILIES = ("identity", "instruction", "cfg", "callgraph", "data-reference", "semantic", "historical-lineage")
RANKS = {"EXACT": 5, "STRONG": 4, "PROBABLE": 3, "AMBIGUOUS": 2, "CONFLICT": 1}


def consensus(functions: DataFrame, proposals: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row per left function: right, decision, strength, families, engines, merge_candidate.

    functions: component, left. proposals: component, engine, left, right, decision, families (those
    that support it). unmatched: component, engine, left where an engine claims no counterpart.
    Engines of one family are not independent, so diversity counts families. A left function without
    a proposal stays UNRESOLVED: unmatched is not gone.
    """
    rank = F.coalesce(*(F.when(F.col("decision") == d, r) for d, r in RANKS.items()), F.lit(0))
    usable = proposals.where(F.col("right").isNotNull() & ~F.col("decision").isin("UNRESOLVED", "ABSTAIN")).withColumn("rank", rank)
    per = usable.groupBy("component", "left", "right").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"), F.count(F.lit(1)).alias("engines"), F.max("rank").alias("rank"),
        F.max(F.col("decision") == "EXACT").alias("any_exact"), F.max(F.col("decision") == "AMBIGUOUS").alias("any_ambiguous"),
    ).withColumn("diversity", F.size("families"))
    order = Window.partitionBy("component", "left").orderBy(F.desc("diversity"), F.desc("engines"), F.desc("rank"), "right")
    whole = Window.partitionBy("component", "left")
    per = per.withColumn("place", F.row_number().over(order)).withColumn("rivals", F.count(F.lit(1)).over(whole) - 1)
    per = per.withColumn("next", F.lead(F.struct("diversity", "engines")).over(order))
    per = per.withColumn("strong_rival", F.max(F.when(F.col("place") > 1, F.col("diversity")).otherwise(0)).over(whole) >= 2).where("place = 1")
    silent = unmatched.groupBy("component", "left").agg(F.count(F.lit(1)).alias("silent"))
    out = functions.join(per, ["component", "left"], "left").join(silent, ["component", "left"], "left")
    tie = (F.col("rivals") > 0) & (F.col("next.diversity") == F.col("diversity")) & (F.col("next.engines") == F.col("engines"))
    against = (F.col("rivals") > 0) | (F.coalesce("silent", F.lit(0)) > 0)
    decision = (
        F.when(F.col("right").isNull(), "UNRESOLVED").when(F.col("strong_rival"), "CONFLICT").when(tie, "AMBIGUOUS").when(F.col("any_exact"), "EXACT")
        .when(F.col("any_ambiguous") & (F.col("engines") == 1), "AMBIGUOUS").when((F.col("diversity") >= 3) & ~against, "STRONG")
        .when((F.col("diversity") >= 2) | (F.col("rank") >= RANKS["STRONG"]), "PROBABLE").otherwise("UNRESOLVED")
    )
    claims = F.count("right").over(Window.partitionBy("component", "right"))
    out = out.withColumn("decision", decision).withColumn("merge_candidate", F.col("right").isNotNull() & (claims > 1))
    shared = F.col("merge_candidate") & F.col("decision").isin("PROBABLE", "STRONG")
    out = out.withColumn("decision", F.when(shared, "AMBIGUOUS").otherwise(F.col("decision")))
    none = F.array().cast("array<string>")
    return out.select(
        "component", "left", "right", "decision", strength(F.col("decision")).alias("strength"), F.coalesce("diversity", F.lit(0)).alias("diversity"),
        F.coalesce("engines", F.lit(0)).cast("long").alias("engines"), F.coalesce("families", none).alias("families"), "merge_candidate",
    )


def candidates(offers: DataFrame, side: str, most: int = 3) -> DataFrame:
    """Per (component, side): the best distinct (other, score) that any engine offered, as an array of structs.

    offers: component, engine, side, other, score; a null score is no offer. Ties go to the lower address.
    """
    own = offers.where("score IS NOT NULL").select("component", side, "other", "score").distinct()
    w = Window.partitionBy("component", side).orderBy(F.desc("score"), "other")
    best = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    ranked = F.array_sort(F.collect_list(F.struct("_n", F.struct("other", "score").alias("c"))))
    return best.groupBy("component", side).agg(ranked.alias("_c")).select("component", side, F.transform("_c", lambda x: x["c"]).alias("candidates"))


def unresolved_left(matches: DataFrame, offers: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Left functions that no engine matched: component, left, candidates and the engines that claim no counterpart."""
    silent = unmatched.groupBy("component", "left").agg(F.array_sort(F.collect_list("engine")).alias("no_counterpart"))
    out = matches.where("right IS NULL").join(candidates(offers, "left"), ["component", "left"], "left").join(silent, ["component", "left"], "left")
    return out.select("component", "left", F.coalesce("candidates", F.array().cast("array<struct<other:bigint,score:double>>")).alias("candidates"), F.coalesce("no_counterpart", F.array().cast("array<string>")).alias("no_counterpart"))


def missing(proposals: DataFrame, expected: list[str]) -> DataFrame:
    """Per component: expected engines that gave nothing and families that nobody measured.

    proposals: component, engine, families_used.
    """
    own = proposals.groupBy("component").agg(F.collect_set("engine").alias("_e"), F.array_distinct(F.flatten(F.collect_list("families_used"))).alias("_f"))
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    return own.select("component", F.array_sort(F.array_except(lit(sorted(expected)), "_e")).alias("missing_engines"), F.array_except(lit(FAMILIES), "_f").alias("missing_families"))


def unmatched_right(functions: DataFrame, matches: DataFrame) -> DataFrame:
    """Right functions that no match took: UNRESOLVED, not new."""
    taken = matches.where("right IS NOT NULL").select("component", "right")
    return functions.join(taken, ["component", "right"], "left_anti").withColumn("decision", F.lit("UNRESOLVED"))
