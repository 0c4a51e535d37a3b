"""N-version lineages: a fold over neighbouring builds, all products at once.

Step k handles the k-th transition of every product in the same few joins, so the number of rounds
is the longest sequence, not the number of products. Between steps stand the current functions with
their lineages and the lost lineages with what is needed to know them again; both are written to the
checkpoint folder. Assignments and links are only appended to.

Inputs (every row carries its product):
builds      product, build, ord (from 1)
functions   product, build, fn, hash, insn_count, mnemonics, cfg_blocks, cfg_edges, cyclomatic, cfg_hash,
            callees, callers (fn ids of the build), callee_names, imports, strings, constants, name, size
matches     product, left_build, right_build, left, right, decision, diversity, merge_candidate,
            candidates (array of struct other, score; of a left row right functions, of a right-only row left ones)
rollbacks   product, build (where a return has a rollback event)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import size_ratio
from ..functions.stats import jaccard, weighted_mean
from . import blocks
from .graph import Grown, _kept, outliving, scratch
from .match import MARGIN, STRONG, WEIGHTS, family_scores, few, greedy

#: Fixed values of the lineage rules.
JOIN = ("EXACT", "STRONG", "PROBABLE")
SPLIT_MIN, MERGE_MIN, RETURN_MIN = 0.40, 0.60, 0.75
TRIVIAL, DATA_ITEMS, DATA_SUPPORT, DATA_CONTRADICT = 8, 2, 0.8, 0.3

#: Instruction counts further apart than this factor leave the weighted mean below RETURN_MIN: all else at 1,
#: (0.35 sqrt(ratio) + 0.65) must reach 0.75, so the ratio 0.0816.
NEAR = 12.3
#: Rows a side, about, that one task pairs with as many of the other side.
PAIR_BLOCK = 1024

ROWS = "product string, build string, lineage string, fn string, relation string, step int"
GRADED = "product string, lineage string, fn string, status string, contradicted boolean"
LINKS = "product string, build string, parent string, child string, relation string, step int"


def _id(*parts: Column) -> Column:
    """A lineage is named by where it began, so that every run gives the same names."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def assess(pairs: DataFrame) -> DataFrame:
    """Grade (old, new) function structs with old_callers, new_callers (lineages) and rollback.

    Adds score, status and contradicted. A contradiction by data or name rejects; CONFIRMED needs
    callers of a common lineage besides exact code, or besides similar code and one more support.
    """
    old, new = F.col("old"), F.col("new")
    fam = family_scores(old, new)
    score = F.coalesce(F.round(weighted_mean(fam, WEIGHTS), 4), F.lit(0.0))
    plain = F.least(old["insn_count"], new["insn_count"]) >= TRIVIAL
    exact = plain & F.coalesce(old["normalized_hash"] == new["normalized_hash"], F.lit(False))
    similar = plain & ~exact & ((0.35 * fam["instruction"] + 0.25 * fam["cfg"]) / 0.60 >= STRONG)
    items = lambda f: F.array_distinct(F.concat(f["strings"], f["constants"]))
    told = (F.size(items(old)) >= DATA_ITEMS) & (F.size(items(new)) >= DATA_ITEMS)
    data = F.when(told, jaccard(items(old), items(new)))
    named = old["name"].isNotNull() & new["name"].isNotNull()
    context = F.arrays_overlap("old_callers", "new_callers")
    yes = lambda c: F.coalesce(c, F.lit(False))
    supports = sum((yes(c).cast("int") for c in (data >= DATA_SUPPORT, named & (old["name"] == new["name"]), context, F.col("rollback"))), F.lit(0))
    contradicted = yes(data < DATA_CONTRADICT) | yes(named & (old["name"] != new["name"]))
    out = pairs.withColumn("score", score).withColumn("_exact", yes(exact)).withColumn("_similar", yes(similar)).withColumn("_supports", supports)
    out = out.withColumn("contradicted", contradicted).withColumn("_context", yes(context)).withColumn("_data", yes(data >= DATA_SUPPORT))
    confirmed = F.col("_context") & ((F.col("_exact") & (F.col("_supports") >= 1)) | (F.col("_similar") & (F.col("_supports") >= 2)))
    candidate = F.col("_exact") | F.col("_similar") | (F.col("score") >= RETURN_MIN) | (F.col("_data") & F.col("_context"))
    status = F.when(F.col("contradicted"), "REJECTED").when(confirmed, "CONFIRMED").when(candidate, "CANDIDATE").otherwise("REJECTED")
    return out.withColumn("status", status).drop("_exact", "_similar", "_supports", "_context", "_data")


def _graded(old: pa.Table, new: pa.Table, every: bool) -> pa.Table:
    """product, lineage, fn, status, contradicted of the pairs of two blocks as assess() grades them where callers have no
    lineage in common and nothing was rolled back; all pairs, or those that are not rejected."""
    l, r = blocks.Side(old), blocks.Side(new)  # noqa: E741
    own = {c: t[c].combine_chunks() for c, t in (("product", old), ("lineage", old), ("fn", new))}
    names, out = pa.array(["REJECTED", "CANDIDATE"]), []
    for lo, hi, families, facts in blocks.strips(l, r):
        plain = np.fmin(*facts["size"]) >= TRIVIAL
        exact = plain & facts["code"]
        similar = plain & ~exact & ((0.35 * families["instruction"] + 0.25 * families["cfg"]) / 0.60 >= STRONG)
        told = (l.length["items"][lo:hi, None] >= DATA_ITEMS) & (r.length["items"][None, :] >= DATA_ITEMS)
        against = (told & (facts["data"] < DATA_CONTRADICT)) | facts["differ"]
        live = ~against & (exact | similar | (blocks.weighted(families, WEIGHTS) >= RETURN_MIN))
        i, j = np.nonzero(live | every)
        a, b = pa.array(i + lo), pa.array(j)
        out.append(pa.table({"product": own["product"].take(a), "lineage": own["lineage"].take(a), "fn": own["fn"].take(b), "status": names.take(pa.array(live[i, j].astype(int))), "contradicted": pa.array(against[i, j])}))
    return pa.concat_tables(out)


def graded_pairs(old: DataFrame, new: DataFrame, every: bool = True, by: tuple[str, ...] = ("product",), block: int = PAIR_BLOCK) -> DataFrame:
    """_graded() of all pairs of old (product, lineage, old) and new (product, fn, new) with the same keys, in blocks."""
    a, b = blocks.numbers(old, *by, "lineage", of="old"), blocks.numbers(new, *by, "fn", of="new")
    return blocks.grouped(a, b, list(by), ("lineage", "fn"), lambda x, y: _graded(x, y, every), GRADED, block)


def resolve(graded: DataFrame) -> DataFrame:
    """At most one claim for each returning function and each lineage, best status and score first.

    graded: product, fn, lineage, score, status. A CONFIRMED claim with a rival within MARGIN on
    either side, among all claims that are not rejected, is taken as CANDIDATE.
    """
    live = _kept(graded.where("status <> 'REJECTED'").select("product", "fn", "lineage", "score", "status"))
    rank = F.when(F.col("status") == "CONFIRMED", 2.0).otherwise(1.0)
    taken = greedy(live.select(F.col("product").alias("component"), F.col("fn").alias("left"), F.col("lineage").alias("right"), (rank * 10 + F.col("score")).alias("score")))
    taken = taken.select(F.col("component").alias("product"), F.col("left").alias("fn"), F.col("right").alias("lineage"))

    def rival(side: str, other: str) -> DataFrame:
        w = Window.partitionBy("product", side).orderBy(F.desc("score"), other)
        top = live.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
        return top.groupBy("product", side).agg(F.max("score").alias(f"best_{side}"), F.min(F.when(F.col("_n") == 2, F.col("score"))).alias(f"next_{side}"), F.min(F.when(F.col("_n") == 1, F.col(other))).alias(f"first_{side}"))

    out = live.join(taken, ["product", "fn", "lineage"], "left_semi").join(rival("fn", "lineage"), ["product", "fn"]).join(rival("lineage", "fn"), ["product", "lineage"])
    beside = lambda side, other: F.when(F.col(f"first_{side}") == F.col(other), F.col(f"next_{side}")).otherwise(F.col(f"best_{side}"))
    close = F.col("score") - F.greatest(beside("fn", "lineage"), beside("lineage", "fn")) < MARGIN
    status = F.when((F.col("status") == "CONFIRMED") & F.coalesce(close, F.lit(False)), "CANDIDATE").otherwise(F.col("status"))
    return out.select("product", "fn", "lineage", "score", status.alias("status"))


def paired(old: DataFrame, new: DataFrame, block: int = PAIR_BLOCK, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Every row of old (product, lineage, ...) beside every row of new (product, fn, ...) of its product, or of
    other common keys.

    Each side of a key is dealt to blocks of about so many rows and each pair of blocks is a join key of
    its own, so that no task pairs a whole product.
    """
    a, b = blocks.dealt(old, new, block, list(by), ("lineage", "fn"))
    return a.join(b, [*by, "_i", "_j"]).drop("_i", "_j")


def _numbers(functions: DataFrame, of: str, callers: str) -> Column:
    """What can be told of a function without its sets and maps: enough for an upper bound of its scores."""
    f = F.col(of)
    prepared = blocks.FIXED in functions.schema[of].dataType.names
    items = F.size(f[blocks.FIXED]["items"] if prepared else F.array_distinct(F.concat(f["strings"], F.transform(f["constants"], lambda c: c.cast("string")))))
    own = {c: f[c] for c in ("normalized_hash", "insn_count", "cfg_blocks", "cfg_edges", "cyclomatic", "cfg_hash", "name")}
    return F.struct(*(v.alias(k) for k, v in own.items()), F.size(f["callees"]).alias("callees"), F.size(f["callers"]).alias("callers"), items.alias("items"), F.col(callers).alias("context"))


def _possible(o: Column, n: Column) -> Column:
    """False only where assess() must reject: names or numbers of items contradict, or from sizes alone no score can be enough.

    A cosine is at most 1, a Jaccard similarity at most the quotient of the sizes; the other families are
    exact. A slack covers the rounding of the families.
    """
    same = lambda f: F.coalesce(o[f] == n[f], F.lit(False))
    instruction = F.when(same("normalized_hash"), 1.0).otherwise(F.sqrt(size_ratio(o["insn_count"], n["insn_count"])))
    cfg = F.when(same("cfg_hash"), 1.0).otherwise(sum((size_ratio(o[f], n[f]) for f in ("cfg_blocks", "cfg_edges", "cyclomatic")), F.lit(0.0)) / 3 * 0.9)
    degree = (size_ratio(o["callees"], n["callees"]) + size_ratio(o["callers"], n["callers"])) / 2
    data = F.try_divide(F.least(o["items"], n["items"]), F.greatest(o["items"], n["items"]))
    named = F.when(o["name"].isNotNull() & n["name"].isNotNull(), (o["name"] == n["name"]).cast("double"))
    best = weighted_mean({"instruction": instruction, "cfg": cfg, "callgraph": (1 + degree) / 2, "data-reference": data, "identity": named}, WEIGHTS)
    similar = (0.35 * instruction + 0.25 * cfg) / 0.60
    context = F.arrays_overlap(o["context"], n["context"]) & (data >= DATA_SUPPORT)
    slack = 0.0005
    against = (F.least(o["items"], n["items"]) >= DATA_ITEMS) & (data < DATA_CONTRADICT - 1e-9)
    differ = o["name"].isNotNull() & n["name"].isNotNull() & (o["name"] != n["name"])
    return ~F.coalesce(against | differ, F.lit(False)) & F.coalesce(same("normalized_hash") | (similar >= STRONG - slack) | (best >= RETURN_MIN - slack) | context, F.lit(True))


def claimable(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (product, lineage, fn) that assess() may not reject.

    old: product, lineage, old, old_callers; new: product, fn, new, new_callers. An enough score needs
    instruction counts within a factor of NEAR: classes of that factor and their neighbours are graded in
    blocks, and only what is not rejected is a pair; equal code and common callers, whatever the size, are joined
    by themselves. There sets and maps stay behind until a pair is possible.
    """
    a = _kept(old.select("product", "lineage", _numbers(old, "old", "old_callers").alias("o")))
    b = _kept(new.select("product", "fn", _numbers(new, "new", "new_callers").alias("n")))
    size_class = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / F.log(F.lit(NEAR)) + 1e-9).cast("int")
    own = size_class(F.col("old.insn_count"))
    near = graded_pairs(old.withColumn("class", F.explode(F.sequence(own - 1, own + 1))), new.withColumn("class", size_class(F.col("new.insn_count"))), False, ("product", "class"), blocks.BLOCK).select("product", "lineage", "fn")
    key = lambda f, c: f.where(F.col(c).isNotNull()).withColumn("_k", F.col(c))
    equal = key(a, "o.normalized_hash").join(key(b, "n.normalized_hash"), ["product", "_k"]).where(_possible(F.col("o"), F.col("n"))).select("product", "lineage", "fn")
    met = a.withColumn("_k", F.explode("o.context")).join(b.withColumn("_k", F.explode("n.context")), ["product", "_k"]).where(_possible(F.col("o"), F.col("n"))).select("product", "lineage", "fn")
    return near.unionByName(equal).unionByName(met).distinct()


def _structs(functions: DataFrame, name: str) -> DataFrame:
    fields = [F.col("hash").alias("normalized_hash"), *(c for c in functions.columns if c not in ("product", "build", "fn", "hash", "ord")), F.array().cast("array<bigint>").alias("linked")]
    return functions.select("product", F.col("fn").alias(f"{name}_fn"), F.struct(*fields).alias(name))


@dataclass
class Run:
    """A folded sequence and where it stands.

    assignments: product, build, lineage, fn, relation, step. links: product, build, parent, child, relation,
    step, where a lineage grew out of another one. current: product, fn, lineage of the newest build compared.
    placed: the same, with lineages that were merged into a function. lost: lineages that may return, with the
    features of their last function and the lineages of its callers.
    """

    assignments: DataFrame
    links: DataFrame
    current: DataFrame
    placed: DataFrame
    lost: DataFrame


def fold(builds: DataFrame, functions: DataFrame, matches: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """All assignments of run(): product, build, lineage, fn, relation, step."""
    return run(builds, functions, matches, rollbacks).assignments


def run(builds: DataFrame, functions: DataFrame, matches: DataFrame, rollbacks: DataFrame | None = None, before: Run | None = None, done: DataFrame | None = None) -> Run:
    """Fold all builds, or those after the done ones.

    done: product, n: how many builds of a product a run before has folded, and before is that run, without
    other products. A transition without matches is a gap: nothing is assigned at it, and what stood before
    the gap neither goes on nor disappears. A right function counts once, however many rows claim it.
    A step reads the features of its own builds only; what it finds is appended to what was found.
    """
    spark = builds.sparkSession
    ends = F.lead("build").over(Window.partitionBy("product").orderBy("ord"))
    none = spark.createDataFrame([], "product string, n int")
    steps = builds.select("product", F.col("build").alias("left_build"), ends.alias("right_build"), F.col("ord").cast("int").alias("ord"))
    steps = steps.join(none if done is None else done.select("product", "n"), "product", "left")
    steps = _kept(steps.where(F.col("ord") >= F.coalesce("n", F.lit(1))))
    todo = steps.where("right_build IS NOT NULL")
    first, last = todo.agg(F.min("ord"), F.max("ord")).first()
    numbered = functions.join(builds.select("product", "build", F.col("ord").cast("int").alias("ord")), ["product", "build"])
    held = Grown(spark, "features", numbered.schema, "ord")
    held.write(numbered)
    feats = lambda k: held.read().where(F.col("ord") == k).drop("ord")
    out, links = Grown(spark, "assignments", ROWS), Grown(spark, "links", LINKS)
    seeds = steps.where("ord = 1 AND n IS NULL").select("product", F.col("left_build").alias("build")).join(feats(1).select("product", "build", "fn"), ["product", "build"])
    seeds = _kept(seeds.select("product", "build", _id("product", "build", "fn").alias("lineage"), "fn", F.lit("UNRESOLVED").alias("relation"), F.lit(0).alias("step")))
    out.write(seeds)
    current = placed = seeds.select("product", "fn", "lineage")
    lost = _lost(seeds.limit(0).select("product", "fn", "lineage"), feats(1), placed)
    if before is not None:
        out.write(before.assignments)
        links.write(before.links)
        current, placed, lost = current.unionByName(before.current), placed.unionByName(before.placed), lost.unionByName(before.lost)
    for k in range(first or 1, (last or 0) + 1):
        now = todo.where(F.col("ord") == k).select("product", "left_build", "right_build")
        with scratch(spark) as work:
            rows = _kept(matches.join(now, ["product", "left_build", "right_build"]))
            new, grown, *state = _step(k, rows, feats(k), feats(k + 1), current, placed, lost, rollbacks)
            out.write(new)
            links.write(grown)
            current, placed, lost = outliving(work, *state)
    return Run(out.read(), links.read(), current, placed, lost)


def _lost(gone: DataFrame, left: DataFrame, placed: DataFrame) -> DataFrame:
    """gone (product, fn, lineage) with the features of the function, and the lineages of those that called it."""
    own = gone.join(_structs(left, "old").withColumnRenamed("old_fn", "fn"), ["product", "fn"])
    callers = own.select("product", "lineage", F.explode("old.callers").alias("c")).join(placed.select("product", F.col("fn").alias("c"), F.col("lineage").alias("cl")), ["product", "c"])
    callers = callers.groupBy("product", "lineage").agg(F.array_sort(F.collect_set("cl")).alias("old_callers"))
    return own.join(callers, ["product", "lineage"], "left").select("product", "lineage", "fn", "old", F.coalesce("old_callers", F.array().cast("array<string>")).alias("old_callers"))


def _step(k, rows, left, right, current, placed, lost, rollbacks):
    compared = rows.select("product", "right_build").distinct()
    numbers = ("product", "fn", "hash", "callers", "callees", "size")
    was, now = left.select(*numbers), right.select(*numbers)
    cur = current.select("product", F.col("fn").alias("left"), "lineage")

    # claims: who of the current functions says to go on as which right function
    claims = rows.where(F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("decision").isin(*JOIN, "AMBIGUOUS"))
    joined = claims.where(F.col("decision").isin(*JOIN)).select("product", "right").distinct()
    claims = claims.join(cur, ["product", "left"])
    whole = Window.partitionBy("product", "right")
    claims = claims.withColumn("parents", F.count(F.lit(1)).over(whole)).withColumn("all_merge", F.min("merge_candidate").over(whole))
    claims = _kept(claims.withColumn("joinable", F.col("decision").isin(*JOIN)))
    merging = claims.where("parents > 1 AND all_merge")
    merged = merging.groupBy("product", "right_build", "right").agg(F.lit("MERGE_PARENT").alias("relation")).withColumn("lineage", _id("product", "right_build", "right"))
    order = whole.orderBy(F.desc("joinable"), F.desc("diversity"), "left")
    best = claims.where("NOT (parents > 1 AND all_merge)").withColumn("_n", F.row_number().over(order)).where("_n = 1 AND joinable")
    best = best.join(was.select("product", F.col("fn").alias("left"), F.col("hash").alias("lh")), ["product", "left"], "left").join(now.select("product", F.col("fn").alias("right"), F.col("hash").alias("rh")), ["product", "right"], "left")
    gone_on = best.select("product", "right_build", "right", "left", "lineage", F.when(F.col("lh") == F.col("rh"), "CONTINUATION").otherwise("MODIFIED").alias("relation"))
    taken = _kept(merged.select("product", "right_build", "right", F.lit(None).cast("string").alias("left"), "lineage", "relation").unionByName(gone_on))
    parents = taken.where("left IS NOT NULL").select("product", F.col("left").alias("parent"), F.col("right").alias("heir"), F.col("lineage").alias("heir_lineage"))

    # right functions nobody claims: called by the heir of a function that they resemble, they split off it
    free = rows.where("right IS NOT NULL").select("product", "right_build", "right").distinct().join(taken, ["product", "right"], "left_anti").join(joined, ["product", "right"], "left_anti")
    free = few(_kept(free.join(now.select("product", F.col("fn").alias("right"), "callers"), ["product", "right"])))
    offers = rows.where("right IS NOT NULL").select("product", "right", F.explode("candidates").alias("c")).select("product", "right", F.col("c.other").alias("parent"), F.col("c.score").alias("score")).where(F.col("score") >= SPLIT_MIN)
    called = free.select("product", "right_build", "right", F.explode("callers").alias("heir"))
    child = called.join(parents, ["product", "heir"]).join(offers, ["product", "right", "parent"])
    child = child.withColumn("_n", F.row_number().over(Window.partitionBy("product", "right").orderBy(F.desc("score"), "parent"))).where("_n = 1")
    split = _kept(child.select("product", "right_build", "right", _id("product", "right_build", "right").alias("lineage"), F.lit("SPLIT_PARENT").alias("relation"), F.col("heir_lineage").alias("of")))
    free = free.join(split, ["product", "right"], "left_anti")

    # the rest may be lineages that return
    settled = taken.select("product", "right", "lineage").unionByName(split.select("product", "right", "lineage"))
    new_callers = free.select("product", "right", F.explode("callers").alias("c")).join(settled.select("product", F.col("right").alias("c"), "lineage"), ["product", "c"]).groupBy("product", "right").agg(F.collect_set("lineage").alias("new_callers"))
    none = F.array().cast("array<string>")
    a = lost.join(compared.select("product"), "product", "left_semi").select("product", "lineage", "old", "old_callers")
    b = free.join(new_callers, ["product", "right"], "left").join(_structs(right, "new").withColumnRenamed("new_fn", "right"), ["product", "right"]).select("product", "right_build", F.col("right").alias("fn"), "new", F.coalesce("new_callers", none).alias("new_callers"))
    ids = _kept(claimable(a, b))
    pairs = few(ids).join(a, ["product", "lineage"]).join(b, ["product", "fn"])
    if rollbacks is None:
        pairs = pairs.withColumn("rollback", F.lit(False))
    else:
        back = rollbacks.select("product", F.col("build").alias("right_build"), F.lit(True).alias("rollback")).distinct()
        pairs = pairs.join(back, ["product", "right_build"], "left").withColumn("rollback", F.coalesce("rollback", F.lit(False)))
    claims_back = _kept(resolve(assess(pairs)).withColumnRenamed("lineage", "old_lineage").withColumnRenamed("fn", "right"))
    free = free.select("product", "right_build", "right").join(claims_back, ["product", "right"], "left")
    sure = F.col("status") == "CONFIRMED"
    returned = free.select(
        "product", "right_build", "right", F.when(sure, F.col("old_lineage")).otherwise(_id("product", "right_build", "right")).alias("lineage"),
        F.when(sure, "RESURRECTED_CONFIRMED").when(F.col("status").isNotNull(), "RESURRECTED_CANDIDATE").otherwise("UNRESOLVED").alias("relation"), F.when(~sure, F.col("old_lineage")).alias("of"),
    )
    alone = F.lit(None).cast("string").alias("of")
    fresh = _kept(taken.select("product", "right_build", "right", "lineage", "relation", alone).unionByName(split).unionByName(returned))

    # a left function without a heir whose candidate grew out of its sibling was merged into it
    continued = taken.where("left IS NOT NULL").select("product", "left").unionByName(merging.select("product", "left")).distinct()
    idle = rows.where("left IS NOT NULL AND right IS NULL").join(cur, ["product", "left"]).join(continued, ["product", "left"], "left_anti")
    wants = idle.select("product", "right_build", "left", "lineage", F.posexplode("candidates").alias("place", "c")).select("product", "right_build", "left", "lineage", "place", F.col("c.other").alias("heir"), F.col("c.score").alias("score"))
    wants = wants.where(F.col("score") >= MERGE_MIN).join(parents, ["product", "heir"])
    own = lambda feats, prefix, key: feats.select("product", F.col("fn").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in ("callers", "callees", "size")))
    wants = wants.join(own(was, "l2", "left"), ["product", "left"]).join(own(was, "l1", "parent"), ["product", "parent"]).join(own(now, "r", "heir"), ["product", "heir"])
    kin = F.arrays_overlap("l1_callers", "l2_callers") | F.array_contains("l1_callees", F.col("left")) | F.array_contains("l2_callees", F.col("parent"))
    absorbed = wants.where(F.coalesce(kin, F.lit(False)) & (F.col("r_size") > F.col("l1_size"))).withColumn("_n", F.row_number().over(Window.partitionBy("product", "left").orderBy("place"))).where("_n = 1")
    absorbed = _kept(absorbed.select("product", "right_build", "left", F.col("heir").alias("right"), "lineage", "heir_lineage"))

    kept = continued.unionByName(absorbed.select("product", "left"))
    seen = rows.where("left IS NOT NULL").select("product", "right_build", "left").distinct()
    gone = cur.join(kept, ["product", "left"], "left_anti").join(fresh.select("product", "lineage"), ["product", "lineage"], "left_anti").join(seen, ["product", "left"])
    gone = few(_kept(gone.select("product", "right_build", "left", "lineage")))

    def shaped(df: DataFrame, fn: str, relation: Column) -> DataFrame:
        return df.select("product", F.col("right_build").alias("build"), "lineage", F.col(fn).alias("fn"), relation.alias("relation"), F.lit(k).alias("step"))

    def linked(df: DataFrame, parent: str, child: str | Column, relation: str | Column) -> DataFrame:
        said = F.lit(relation) if isinstance(relation, str) else relation
        return df.select("product", F.col("right_build").alias("build"), F.col(parent).alias("parent"), (F.col(child) if isinstance(child, str) else child).alias("child"), said.alias("relation"), F.lit(k).alias("step"))

    new = shaped(fresh, "right", F.col("relation")).unionByName(shaped(absorbed, "right", F.lit("MERGE_PARENT"))).unionByName(shaped(gone, "left", F.lit("DISAPPEARED")))
    links = linked(merging, "lineage", _id("product", "right_build", "right"), "MERGE_PARENT").unionByName(linked(fresh.where("of IS NOT NULL"), "of", "lineage", F.col("relation"))).unionByName(linked(absorbed, "lineage", "heir_lineage", "MERGE_PARENT"))
    heirs = fresh.select("product", F.col("right").alias("fn"), "lineage")
    waits = lambda state: state.join(compared.select("product"), "product", "left_anti")  # noqa: E731  # a gap, or the sequence is over
    used = claims_back.select("product", F.col("old_lineage").alias("lineage"))
    dead = _lost(gone.select("product", F.col("left").alias("fn"), "lineage"), left, placed)
    lost = lost.join(used, ["product", "lineage"], "left_anti").unionByName(dead)
    placed = heirs.unionByName(absorbed.select("product", F.col("right").alias("fn"), "lineage")).unionByName(waits(placed))
    return new, links, heirs.unionByName(waits(current)), placed, lost


def summary(assignments: DataFrame) -> DataFrame:
    """Per lineage: assignments, relations, first step."""
    return assignments.groupBy("product", "lineage").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("relation")).alias("relations"), F.min("step").alias("first_step"))


def lineage_quality(assignments: DataFrame, truth: DataFrame, versions: int) -> DataFrame:
    """Purity, fragmentation and recovery against truth (product, build, fn, logical).

    strict_recovery also asks for an assignment in every version that the logical function is in.
    """
    own = assignments.where("relation <> 'DISAPPEARED'").join(truth, ["product", "build", "fn"])
    pure = own.groupBy("product", "lineage").agg(F.countDistinct("logical").alias("d"))
    want = truth.groupBy("product", "logical").agg(F.countDistinct("build").alias("want"))
    parts = want.join(own.groupBy("product", "logical").agg(F.countDistinct("lineage").alias("d"), F.countDistinct("build").alias("got")), ["product", "logical"], "left")
    a = pure.agg(F.count(F.lit(1)).alias("lineages"), F.avg((F.col("d") == 1).cast("double")).alias("purity"))
    b = parts.agg(
        F.avg((F.col("d") > 1).cast("double")).alias("fragmentation"), F.avg(F.when(F.col("want") >= versions, (F.coalesce("d", F.lit(0)) == 1).cast("double"))).alias("recovery"),
        F.avg(F.when(F.col("want") >= versions, ((F.coalesce("d", F.lit(0)) == 1) & (F.col("got") == F.col("want"))).cast("double"))).alias("strict_recovery"),
    )
    return a.join(b)
