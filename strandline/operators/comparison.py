"""Whole comparisons: matcher, consensus, lineages, changes and scores, each on what the one before gave.

Every step takes all products, neighbouring builds and parts at once. Frames:

builds      product, build, ord (from 1)
functions   product, build, part, entry and the features of match.py; a part is what is compared with the
            part of that name in the next build
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, changes, consensus, lineage, match, truth
from .graph import _kept

ENGINE = "features"
KEYS = ("product", "part", "left_build", "right_build")


def function_id(build: str, part: str, entry: str) -> Column:
    """A function's name in its product."""
    return F.concat_ws("|", build, part, F.col(entry).cast("string"))


def transitions(builds: DataFrame) -> DataFrame:
    """product, left_build, right_build of neighbouring builds."""
    w = Window.partitionBy("product").orderBy("ord")
    return builds.select("product", F.col("build").alias("left_build"), F.lead("build").over(w).alias("right_build")).where("right_build IS NOT NULL")


def sides(functions: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, right, compared): the functions of both sides of every step as components of their own, and what
    the components stand for. A part that only one build has is not compared."""
    parts = functions.select("product", "build", "part").distinct()
    a = steps.join(parts.withColumnRenamed("build", "left_build"), ["product", "left_build"])
    compared = a.join(parts.withColumnRenamed("build", "right_build"), ["product", "right_build", "part"]).select(*KEYS, F.sha2(F.to_json(F.struct(*KEYS)), 256).alias("component"))
    compared = _kept(compared)

    def side(own: str) -> DataFrame:
        key = compared.select("component", "product", "part", F.col(own).alias("build"))
        return functions.join(key, ["product", "build", "part"]).drop("product", "build", "part")

    return side("left_build"), side("right_build"), compared


@dataclass
class Comparison:
    """What the engines and their consensus say of every component (compared: what a component stands for).

    matches: component, left, right, decision, strength, diversity, engines, families, merge_candidate, side and
    candidates (structs other, score); rows of side right-only have no left. scored: the matcher's own pairs.
    """

    left: DataFrame
    right: DataFrame
    compared: DataFrame
    scored: DataFrame
    matches: DataFrame


def compare(functions: DataFrame, steps: DataFrame, others: DataFrame | None = None, offers: bool = True, kin: bool = False) -> Comparison:
    """Match both sides of all steps and reconcile what the engines say.

    Every step reads functions anew, so they should be kept rows.
    others: proposals of further engines, with product, part, left_build, right_build, engine, left, right,
    decision and families. A left function without a proposal is UNRESOLVED and keeps its best candidates; so
    is a right function that no match takes. Without offers nobody is looked for who is only a candidate, and all
    candidates are empty; decisions do not depend on them. With kin they are looked for where a lineage can use them only:
    for functions that are near a match in the call graph.
    """
    left, right, compared = sides(functions, steps)
    scored = _kept(match.match(left, right))
    families = F.transform(F.filter(match.evidence({k: F.col(f"`{k}`") for k in match.WEIGHTS}), lambda e: e["supports"]), lambda e: e["family"])
    proposals = scored.select("component", F.lit(ENGINE).alias("engine"), "left", "right", "decision", families.alias("families"))
    if others is not None:
        proposals = proposals.unionByName(others.join(compared, list(KEYS)).select(*proposals.columns))
    silent = left.select("component", F.col("entry").alias("left")).join(scored.select("component", "left"), ["component", "left"], "left_anti")
    own = _kept(consensus.consensus(left.select("component", F.col("entry").alias("left")), proposals, silent.withColumn("engine", F.lit(ENGINE))))
    asked = match.few(_kept(match.near_matches(left, right, own.where("right IS NOT NULL").select("component", "left", "right")))) if offers and kin else None
    found = _kept(match.leftovers(left, right, scored.select("component", "left", "right"), asked=asked)) if offers else left.sparkSession.createDataFrame([], match.OFFERS)
    best = lambda side: consensus.candidates(found.where(F.col("side") == side).select("component", F.lit(ENGINE).alias("engine"), F.col("own").alias(side), "other", "score"), side)
    none = F.array().cast("array<struct<other: bigint, score: double>>")
    rows = own.join(best("left"), ["component", "left"], "left").withColumns({"side": F.lit("left"), "candidates": F.when(F.col("right").isNull(), F.coalesce("candidates", none)).otherwise(none)})
    lone = consensus.unmatched_right(right.select("component", F.col("entry").alias("right")), own).join(best("right"), ["component", "right"], "left")
    lone = lone.select(
        "component", F.lit(None).cast("long").alias("left"), "right", "decision", F.lit("LOW").alias("strength"), F.lit(0).alias("diversity"), F.lit(0).cast("long").alias("engines"),
        F.array().cast("array<string>").alias("families"), F.lit(False).alias("merge_candidate"), F.lit("right-only").alias("side"), F.coalesce("candidates", none).alias("candidates"),
    )
    return Comparison(left, right, compared, scored, _kept(rows.select(*lone.columns).unionByName(lone)))


def as_lineage(functions: DataFrame) -> DataFrame:
    """Functions as the fold takes them: names of functions are those of their builds and parts."""
    name = lambda c: F.transform(c, lambda e: F.concat_ws("|", "build", "part", e.cast("string")))
    rest = ("insn_count", "mnemonics", "cfg_blocks", "cfg_edges", "cyclomatic", "cfg_hash", "callee_names", "imports", "strings", "constants", "name", "size", *({blocks.FIXED} & set(functions.columns)))
    return functions.select("product", "build", function_id("build", "part", "entry").alias("fn"), F.col("normalized_hash").alias("hash"), name("callees").alias("callees"), name("callers").alias("callers"), *rest)


def lineage_rows(c: Comparison) -> DataFrame:
    """The consensus as the fold takes it."""
    own = c.matches.join(c.compared, "component")
    named = lambda build, entry: F.when(F.col(entry).isNotNull(), function_id(build, "part", entry))
    of = F.when(F.col("side") == "left", F.col("right_build")).otherwise(F.col("left_build"))
    offers = F.transform("candidates", lambda x: F.struct(F.concat_ws("|", of, F.col("part"), x["other"].cast("string")).alias("other"), x["score"].alias("score")))
    return own.select("product", "left_build", "right_build", named("left_build", "left").alias("left"), named("right_build", "right").alias("right"), "decision", "diversity", "merge_candidate", offers.alias("candidates"))


def lineages(builds: DataFrame, functions: DataFrame, c: Comparison, rollbacks: DataFrame | None = None) -> lineage.Run:
    return lineage.run(builds, as_lineage(functions), lineage_rows(c), rollbacks)


def structural_changes(c: Comparison) -> DataFrame:
    """Per compared part: functions, modified and unresolved ones, growth of the cyclomatic number."""
    side = lambda f: f.select("component", F.col("entry").alias("address"), F.col("normalized_hash").alias("hash"), "cyclomatic")
    return changes.modified(c.matches, side(c.left), side(c.right)).join(c.compared, "component").drop("component")


@dataclass
class Truth:
    """functions: product, part, build, address, name. relations: product, part, from, to, kind (pair, split, merge,
    return), left, right; from and to are builds. A transition without any relation is not scored."""

    functions: DataFrame
    relations: DataFrame


def transition_scores(c: Comparison, t: Truth) -> DataFrame:
    """Per compared part that the truth knows: tp, fp, fn, precision, recall, f1, coverage, false_new, false_new_rate."""
    steps = t.relations.where("kind <> 'return'").select("product", "part", F.col("from").alias("left_build"), F.col("to").alias("right_build"), "kind", "left", "right")
    known = _kept(steps.select(*KEYS).distinct().join(c.compared, list(KEYS)))
    named = t.functions.join(known.select("product", "part", F.col("left_build").alias("build"), "component"), ["product", "part", "build"]).select("component", F.col("address").alias("left"))
    want = _kept(truth.required_pairs(steps.join(known, list(KEYS)).select("component", "kind", "left", "right")))
    ours = c.matches.join(known.select("component"), "component", "left_semi")
    predicted = ours.where("side = 'left'").join(named, ["component", "left"], "left_semi").select("component", "left", "right", "decision")
    seen = lambda f, side: f.join(known.select("component"), "component", "left_semi").select("component", F.lit(side).alias("side"), F.col("entry").alias("address"))
    extracted = seen(c.left, "left").unionByName(seen(c.right, "right"))
    alone = ours.where("side = 'right-only'").select("component", "right")
    out = truth.transition(predicted, want, extracted, alone, "component", named)
    return out.join(known, "component").drop("component")


def lineage_scores(run: lineage.Run, t: Truth, builds: DataFrame) -> DataFrame:
    """Per product: what its lineages are worth against the truth."""
    vertex = lambda build, address: F.concat_ws("|", "product", build, "part", F.col(address).cast("string"))
    functions = t.functions.select("product", F.col("build").alias("version"), vertex("build", "address").alias("v"))
    edges = t.relations.select(vertex("from", "left").alias("a"), vertex("to", "right").alias("b"))
    logical = _kept(truth.logical_functions(functions, edges).join(functions, "v"))
    own = run.assignments.where("relation <> 'DISAPPEARED'").select("product", "lineage", F.col("build").alias("version"), F.concat_ws("|", "product", "fn").alias("v"))
    returns = t.relations.where("kind = 'return'").select("product", vertex("to", "right").alias("v"))
    versions = builds.groupBy("product").agg(F.count(F.lit(1)).alias("versions"))
    return truth.scores_by_product(own, logical, run.links.select("product", "parent", "child", "relation"), versions, returns)
