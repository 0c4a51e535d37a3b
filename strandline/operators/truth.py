"""Benchmark against a ground truth: logical functions, transitions, lineages and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import precision_recall
from .graph import _kept, components

JOIN = ("EXACT", "STRONG", "PROBABLE")


def required_pairs(truth: DataFrame) -> DataFrame:
    """truth: key..., kind ('pair', 'split', 'merge'), left, right -> left, right, required: only pairs must be found,
    the others may be."""
    keys = [c for c in truth.columns if c != "kind"]
    return truth.groupBy(*keys).agg(F.max(F.col("kind") == "pair").alias("required"))


def transition(predicted: DataFrame, truth: DataFrame, extracted: DataFrame, right_only: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Per key: tp, fp, fn, precision, recall, f1, coverage, false_new and false_new_rate of a comparison.

    predicted: key, left, right, decision; only joining decisions of left functions that the truth knows
    count. truth: key, left, right, required. extracted: key, side, address. right_only: key, right that no
    match took: one that a required pair of extracted functions leads to was falsely left as new. known: key,
    left of all functions that the truth names, if it names more than those of its pairs.
    """
    known = (truth if known is None else known).select(key, "left").distinct()
    own = predicted.where(F.col("decision").isin(*JOIN) & F.col("right").isNotNull()).join(known, [key, "left"], "left_semi").select(key, "left", "right").distinct()
    found = lambda side: extracted.where(F.col("side") == side).select(key, F.col("address").alias(side)).distinct()
    t = truth.join(found("left").withColumn("_l", F.lit(True)), [key, "left"], "left").join(found("right").withColumn("_r", F.lit(True)), [key, "right"], "left")
    t = t.join(right_only.select(key, "right").distinct().withColumn("_o", F.lit(True)), [key, "right"], "left")
    both = own.withColumn("_p", F.lit(True)).join(t.withColumn("_t", F.lit(True)), [key, "left", "right"], "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    need, usable = yes("_t") & yes("required"), yes("_l") & yes("_r")
    out = both.groupBy(key).agg(
        F.count_if(yes("_p") & yes("_t")).alias("tp"), F.count_if(yes("_p") & ~yes("_t")).alias("fp"), F.count_if(need & ~yes("_p")).alias("fn"), F.count_if(need & usable).alias("_usable"), F.count_if(need & usable & yes("_o")).alias("false_new"),
    )
    left = known.join(found("left").withColumn("_l", F.lit(True)), [key, "left"], "left").groupBy(key).agg(F.try_divide(F.count_if(yes("_l")), F.count(F.lit(1))).alias("coverage"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.join(left, key, "left").withColumns({"precision": p, "recall": r, "f1": f1, "false_new_rate": F.try_divide("false_new", "_usable")}).drop("_usable")


def class_precision(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per decision: predictions and how many of them the truth accepts."""
    t = truth.select(key, "left", "right").distinct().withColumn("_t", F.lit(True))
    own = predicted.join(t, [key, "left", "right"], "left")
    return own.groupBy(key, "decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("_t", F.lit(False))).alias("correct"))


def logical_functions(functions: DataFrame, relations: DataFrame) -> DataFrame:
    """(v, logical): functions that pairs, splits, merges or returns connect are one logical function, named by its least.

    functions: v; relations: a, b. All components at once; a function without a relation stands for itself.
    """
    return components(relations, functions.select("v")).withColumnRenamed("component", "logical")


def linked(lineages: DataFrame, links: DataFrame) -> DataFrame:
    """(lineage, island): lineages that recorded links (parent, child) connect are one island."""
    edges = links.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return components(edges, lineages.select(F.col("lineage").alias("v")).distinct()).select(F.col("v").alias("lineage"), F.col("component").alias("island"))


def lineage_scores(assigned: DataFrame, logical: DataFrame, links: DataFrame, n_versions: int) -> DataFrame:
    """One row: purity, wrong merges, fragmentation with and without links, recovery in three strengths, false candidates.

    assigned: lineage, version, v (no DISAPPEARED rows); logical: v, version, logical; links: parent, child,
    relation. Counts come first and are joined over single rows, so nothing is gathered.
    strict_recovery asks, beyond one lineage, for an assignment in every version.
    """
    own = assigned.join(logical.select("v", "logical"), "v")
    islands = linked(own.select("lineage").union(links.select("parent")).union(links.select("child")).distinct(), links)
    per_lineage = own.groupBy("lineage").agg(F.countDistinct("logical").alias("d"))
    per_logical = own.join(islands, "lineage").groupBy("logical").agg(F.countDistinct("lineage").alias("d"), F.countDistinct("island").alias("islands"), F.countDistinct("version").alias("got"))
    want = logical.groupBy("logical").agg(F.countDistinct("version").alias("want"))
    chains = want.where(F.col("want") == n_versions).join(per_logical, "logical", "left")
    members = own.select("lineage", "logical").distinct()
    common = links.where("relation = 'RESURRECTED_CANDIDATE'").select("parent", "child").join(members.select(F.col("lineage").alias("parent"), "logical"), "parent").join(members.select(F.col("lineage").alias("child"), "logical"), ["child", "logical"]).select("parent", "child").distinct()
    false_leads = links.where("relation = 'RESURRECTED_CANDIDATE'").join(common, ["parent", "child"], "left_anti")
    a = per_lineage.agg(F.count(F.lit(1)).alias("lineages"), F.count_if(F.col("d") > 1).alias("wrong_merge"))
    b = per_logical.agg(F.count(F.lit(1)).alias("logical"), F.count_if(F.col("d") > 1).alias("wrong_split"), F.count_if(F.col("islands") > 1).alias("wrong_split_unlinked"))
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    c = chains.agg(F.count(F.lit(1)).alias("full_chains"), one(F.col("d") == 1).alias("recovered"), one(F.col("islands") == 1).alias("recovered_linked"), one((F.col("d") == 1) & (F.col("got") == n_versions)).alias("recovered_strict"))
    d = false_leads.agg(F.count(F.lit(1)).alias("false_resurrection_candidates"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d)  # single rows
    share = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return out.withColumns({
        "purity": 1 - share("wrong_merge", "lineages"), "fragmentation": share("wrong_split", "logical"), "fragmentation_unlinked": share("wrong_split_unlinked", "logical"), "multi_version_recovery": share("recovered", "full_chains"),
        "multi_version_recovery_linked": share("recovered_linked", "full_chains"), "strict_recovery": share("recovered_strict", "full_chains"),
    })


def scores_by_product(assigned: DataFrame, logical: DataFrame, links: DataFrame, versions: DataFrame, returns: DataFrame) -> DataFrame:
    """Per product: lineages, purity, fragmentation, recovery, outcomes of returns, false candidates.

    assigned: product, lineage, version, v (no DISAPPEARED rows); logical: v, product, version, logical; links:
    product, parent, child, relation; versions: product, versions; returns: product, v of what truly came back.
    A logical function whose lineages recorded links connect is fragmented, but not lost.
    """
    own = _kept(assigned.select("product", "lineage", "v").join(logical.select("v", "logical"), "v"))
    both = links.select("product", F.col("parent").alias("lineage")).unionByName(links.select("product", F.col("child").alias("lineage")))
    islands = _kept(linked(own.select("lineage").unionByName(both.select("lineage")).distinct(), links))
    members = _kept(own.select("product", "lineage", "logical").distinct())
    per_lineage = members.groupBy("product", "lineage").agg(F.count(F.lit(1)).alias("d")).groupBy("product").agg(F.count(F.lit(1)).alias("lineages"), F.count_if(F.col("d") > 1).alias("wrong_merge"))
    per_logical = _kept(members.join(islands, "lineage").groupBy("product", "logical").agg(F.count(F.lit(1)).alias("d"), F.countDistinct("island").alias("islands")))
    split = per_logical.groupBy("product").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("d") > 1).alias("wrong_split"), F.count_if(F.col("islands") > 1).alias("wrong_split_unlinked"))
    want = logical.groupBy("product", "logical").agg(F.countDistinct("version").alias("want")).join(versions, "product").where("want = versions")
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    chains = want.join(per_logical, ["product", "logical"], "left").groupBy("product").agg(F.count(F.lit(1)).alias("_full"), one(F.col("d") == 1).alias("_got"), one(F.col("islands") == 1).alias("_linked"))
    outcome = F.when(F.col("d") == 1, "confirmed").when(F.col("islands") == 1, "candidate_linked").otherwise("missed")
    back = returns.join(logical.select("v", "logical"), "v", "left").join(per_logical, ["product", "logical"], "left").groupBy("product").agg(*(F.count_if(outcome == o).alias(o) for o in ("confirmed", "candidate_linked", "missed")))
    leads = links.where("relation = 'RESURRECTED_CANDIDATE'").select("product", "parent", "child").distinct()
    met = leads.join(members.select(F.col("lineage").alias("parent"), "logical"), "parent").join(members.select(F.col("lineage").alias("child"), "logical"), ["child", "logical"])
    false = leads.join(met.select("parent", "child"), ["parent", "child"], "left_anti").groupBy("product").agg(F.count(F.lit(1)).alias("false_resurrection_candidates"))
    out = versions.select("product")
    for part in (per_lineage, split, chains, back, false):
        out = out.join(part, "product", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda x, y: F.try_divide(F.col(x), F.nullif(F.col(y), F.lit(0)))
    return out.select(
        "product", *map(zero, ("lineages", "wrong_merge", "wrong_split", "wrong_split_unlinked", "confirmed", "candidate_linked", "missed", "false_resurrection_candidates")), (1 - share("wrong_merge", "lineages")).alias("purity"),
        share("wrong_split", "_n").alias("fragmentation"), share("wrong_split_unlinked", "_n").alias("fragmentation_unlinked"), share("_got", "_full").alias("multi_version_recovery"), share("_linked", "_full").alias("multi_version_recovery_linked"),
    )


def return_outcomes(returns: DataFrame, logical: DataFrame, assigned: DataFrame, links: DataFrame) -> DataFrame:
    """Each true return (v of the function that came back): confirmed, candidate_linked or missed."""
    own = assigned.join(logical.select("v", "logical"), "v")
    islands = linked(own.select("lineage").distinct(), links)
    per = own.join(islands, "lineage").groupBy("logical").agg(F.countDistinct("lineage").alias("d"), F.countDistinct("island").alias("islands"))
    out = returns.join(logical.select("v", "logical"), "v", "left").join(per, "logical", "left")
    outcome = F.when(F.col("d") == 1, "confirmed").when(F.col("islands") == 1, "candidate_linked").otherwise("missed")
    return out.select("v", outcome.alias("outcome"))


def totals(transitions: DataFrame) -> DataFrame:
    """Sums of all transitions and their mean coverage; one that was not measured counts as none."""
    out = transitions.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "false_new")), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("coverage"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1})
