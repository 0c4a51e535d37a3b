"""Planning of analyses and the state of their runs, as tables.

A node is a processor applied to an artifact or to a pair of them. Specs are few (a profile's
processors) and live on the driver; nodes, results and jobs are DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a job may go from state to state, and the states that end it.
JOB_STATES = {
    "QUEUED": ("PREPARING", "CANCELLING", "BLOCKED_DEPENDENCY", "INTERRUPTED"),
    "BLOCKED_DEPENDENCY": ("QUEUED", "CANCELLING", "FAILED_PERMANENT"),
    "PREPARING": ("RUNNING", "CANCELLING", "FAILED_RETRYABLE", "FAILED_PERMANENT", "INTERRUPTED"),
    "RUNNING": ("PAUSING", "POST_PROCESSING", "CANCELLING", "FAILED_RETRYABLE", "FAILED_PERMANENT", "INTERRUPTED", "HUNG"),
    "PAUSING": ("PAUSED", "RUNNING", "CANCELLING", "INTERRUPTED"),
    "PAUSED": ("RESUMING", "CANCELLING", "INTERRUPTED"),
    "RESUMING": ("RUNNING", "FAILED_RETRYABLE", "INTERRUPTED"),
    "POST_PROCESSING": ("COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT", "INTERRUPTED"),
    "HUNG": ("CANCELLING", "FAILED_RETRYABLE"),
    "CANCELLING": ("CANCELLED",),
    "FAILED_RETRYABLE": ("QUEUED", "FAILED_PERMANENT"),
    "INTERRUPTED": ("RECOVERING",),
    "RECOVERING": ("QUEUED", "FAILED_PERMANENT"),
}
TERMINAL = ("COMPLETED", "CANCELLED", "FAILED_PERMANENT")
ACTIVE = ("PREPARING", "RUNNING", "PAUSING", "RESUMING", "POST_PROCESSING")
#: Outcomes that count as evidence, and planned skips, which are not missing evidence.
GOOD = ("SUCCESS", "SUCCESS_WITH_WARNINGS")
PLANNED_SKIPS = ("SKIPPED_INCOMPATIBLE", "SKIPPED_POLICY")
#: Completion states from best to worst.
COMPLETION = ("COMPLETE", "PARTIAL", "INVALID")
#: Health states from best to worst; NOT_AVAILABLE counts as WARN.
HEALTH = {"OK": 0, "NOT_AVAILABLE": 1, "WARN": 1, "FAIL": 2}


@dataclass(frozen=True)
class Spec:
    """A processor: scope 'artifact' or 'pair', what it needs, what it takes."""

    id: str
    scope: str = "artifact"
    needs: tuple[str, ...] = ()
    wants: tuple[str, ...] = ()
    formats: tuple[str, ...] | None = None
    provider: str | None = None
    heavy: bool = False
    determinism: str = "D0"
    options: dict = field(default_factory=dict)


def in_order(specs: list[Spec]) -> list[Spec]:
    """Specs after everything that they need or want; the given order where that leaves a choice. A cycle raises."""
    by_id, out, placed = {s.id: s for s in specs}, [], set()
    waiting = list(specs)
    while waiting:
        ready = next((s for s in waiting if all(d in placed or d not in by_id for d in (*s.needs, *s.wants))), None)
        if ready is None:
            raise ValueError("processors that need each other: " + ", ".join(s.id for s in waiting))
        out.append(ready)
        placed.add(ready.id)
        waiting.remove(ready)
    return out


def require_mandatory(specs: list[Spec], available: set[str], mandatory: set[str]) -> None:
    """Refuse a profile whose mandatory provider is not there, rather than run without it."""
    lacking = sorted(s.provider for s in specs if s.provider in mandatory and s.provider not in available)
    if lacking:
        raise ValueError("the profile needs " + ", ".join(lacking))


def plan(specs: list[Spec], targets: DataFrame, available: set[str], allow_d3: bool = False) -> DataFrame:
    """A row for each node: processor, scope, left, right, left_format, right_format, needs, wants, skip, reason.

    targets: left, right (null for a single artifact), left_format, right_format. The specs of a scope
    are an array on each target, so that nothing is joined. A node that cannot run stays, with the
    first reason of: format, provider, identical bytes of a heavy pair.
    """
    order, own = in_order(specs), {s.id: s for s in specs}

    def struct(s: Spec) -> Column:
        wants = [w for w in s.wants if w in own and (allow_d3 or own[w].determinism != "D3")]
        strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
        return F.struct(
            F.lit(s.id).alias("processor"), F.lit(s.scope).alias("scope"), strings([n for n in s.needs if n in own]).alias("needs"), strings(wants).alias("wants"),
            F.lit(None if s.formats is None else list(s.formats)).cast("array<string>").alias("formats"), F.lit(s.provider).cast("string").alias("provider"),
            F.lit(s.provider is None or s.provider in available).alias("there"), F.lit(s.heavy).alias("heavy"),
        )

    pair = F.col("right").isNotNull()
    of = lambda scope: F.array(*(struct(s) for s in order if s.scope == scope))
    choices = [(scope, of(scope)) for scope in ("artifact", "pair") if any(s.scope == scope for s in order)]
    parts = [targets.where(pair if scope == "pair" else ~pair).select("*", F.explode(a).alias("s")) for scope, a in choices]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fits = F.array_contains("s.formats", F.col("left_format")) & (~pair | F.array_contains("s.formats", F.col("right_format")))
    bad_format = F.col("s.formats").isNotNull() & ~F.coalesce(fits, F.lit(False))
    identical = pair & F.col("s.heavy") & (F.col("left") == F.col("right"))
    skip = F.when(bad_format, "SKIPPED_INCOMPATIBLE").when(~F.col("s.there"), "SKIPPED_UNSUPPORTED").when(identical, "SKIPPED_POLICY")
    reason = F.when(bad_format, "input format not supported").when(~F.col("s.there"), "provider unavailable").when(identical, "identical bytes on both sides")
    return rows.select("s.processor", "s.scope", "left", "right", "left_format", "right_format", "s.needs", "s.wants", skip.alias("skip"), reason.alias("reason"))


def dependencies(nodes: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Edges (processor, left, right, need, side, dep_left, dep_right): what each node needs, and from which side.

    A pair needs an artifact's processor twice, once for each side; another pair's once.
    """
    needs = nodes.select("processor", "left", "right", F.explode("needs").alias("need"))
    of_pair = F.coalesce(*(F.when(F.col("need") == p, scope == "pair") for p, scope in scopes.items()), F.lit(False))
    side = lambda s: F.lit(s).alias("side")
    none = F.lit(None).cast("string")
    structs = F.when(of_pair, F.array(F.struct(side("pair"), F.col("left").alias("dep_left"), F.col("right").alias("dep_right"))))
    structs = structs.when(F.col("right").isNull(), F.array(F.struct(side("subject"), F.col("left").alias("dep_left"), none.alias("dep_right"))))
    structs = structs.otherwise(F.array(F.struct(side("left"), F.col("left").alias("dep_left"), none.alias("dep_right")), F.struct(side("right"), F.col("right").alias("dep_left"), none.alias("dep_right"))))
    return needs.select("processor", "left", "right", "need", F.explode(structs).alias("d")).select("processor", "left", "right", "need", "d.*")


def resolved(nodes: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """nodes with `skip` also set where something needed has no result: SKIPPED_UNSUPPORTED, naming the first such need.

    results: processor, left, right of nodes that have one.
    """
    have = results.select(F.col("processor").alias("need"), F.col("left").alias("dep_left"), F.col("right").alias("dep_right"))
    lacking = edges.join(have, (edges["need"] == have["need"]) & edges["dep_left"].eqNullSafe(have["dep_left"]) & edges["dep_right"].eqNullSafe(have["dep_right"]), "left_anti")
    first = lacking.groupBy("processor", "left", "right").agg(F.min("need").alias("_need")).select(F.col("processor").alias("_p"), F.col("left").alias("_l"), F.col("right").alias("_r"), "_need")
    out = nodes.join(first, (nodes["processor"] == first["_p"]) & nodes["left"].eqNullSafe(first["_l"]) & nodes["right"].eqNullSafe(first["_r"]), "left")
    hurt = F.col("skip").isNull() & F.col("_need").isNotNull()
    reason = F.when(hurt, F.concat(F.lit("dependency "), F.col("_need"), F.lit(" unavailable"))).otherwise(F.col("reason"))
    return out.withColumns({"reason": reason, "skip": F.when(hurt, "SKIPPED_UNSUPPORTED").otherwise(F.col("skip"))}).drop("_p", "_l", "_r", "_need")


def heavy_gate(n_left: Column, n_right: Column, most: int, bytes_a_pair: int, memory: int) -> Column:
    """Why a heavy matcher would be refused: too many functions on a side, or too large a matrix; null if not.
    Unknown counts refuse nothing."""
    known = n_left.isNotNull() & n_right.isNotNull()
    many = F.greatest(n_left, n_right) > most
    large = (n_left > 0) & (n_right > 0) & (n_left.cast("double") * n_right * bytes_a_pair > memory)
    return F.when(known & many, "FUNCTION_COUNT").when(known & large, "MEMORY")


def to_do(nodes: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do: nodes without a settled result."""
    return nodes.join(done.select(*key).distinct(), key, "left_anti")


def cache_state(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """Each node (node, cache_key) with HIT, CORRUPTED, MISS, or WAIT if an earlier node of its key computes it.

    cache: cache_key, state, sha256 (as registered), digest (as read, null if gone). Only a CURRENT entry
    counts, and one whose file changed is never a hit.
    """
    live = cache.where("state = 'CURRENT'").select("cache_key", F.coalesce(F.col("digest") == F.col("sha256"), F.lit(False)).alias("_sound"))
    out = nodes.join(live, "cache_key", "left")
    first = F.row_number().over(Window.partitionBy("cache_key").orderBy("node"))
    state = F.when(F.col("_sound"), "HIT").when(F.col("_n") > 1, "WAIT").when(F.col("_sound").isNotNull(), "CORRUPTED").otherwise("MISS")
    return out.withColumn("_n", first).select("node", "cache_key", state.alias("lookup"))


def run_state(nodes: DataFrame, run: str) -> DataFrame:
    """Per run: applicable nodes, those that succeeded, coverage, missing evidence and status.

    nodes: run, processor, outcome, skip. Planned skips are neither applicable nor missing. PARTIAL
    outcomes keep a run from failing, but are missing evidence.
    """
    applicable = F.col("skip").isNull() | ~F.col("skip").isin(*PLANNED_SKIPS)
    good = F.col("outcome").isin(*GOOD)
    out = nodes.groupBy(run).agg(
        F.count_if(applicable).alias("applicable"), F.count_if(applicable & good).alias("ok"), F.count_if(applicable & ~good).alias("missing"),
        F.count_if(applicable & (good | (F.col("outcome") == "PARTIAL"))).alias("_produced"), F.array_sort(F.collect_set(F.when(applicable & ~good, F.col("processor")))).alias("missing_processors"),
    )
    status = F.when((F.col("applicable") > 0) & (F.col("_produced") == 0), "FAILED").when(F.col("missing") > 0, "COMPLETED_PARTIAL").otherwise("COMPLETED")
    return out.withColumns({"coverage": F.try_divide("ok", "applicable"), "status": status}).drop("_produced")


def outcome_matrix(nodes: DataFrame, run: str) -> DataFrame:
    """Nodes of each run and processor by outcome."""
    return nodes.groupBy(run, "processor", "outcome").agg(F.count(F.lit(1)).alias("n"))


def worst(states: Column, order: tuple[str, ...] = COMPLETION) -> Column:
    """Of an array of states the one latest in order; the first of order if there is none."""
    place = F.transform(states, lambda s: F.coalesce(*(F.when(s == name, k) for k, name in enumerate(order)), F.lit(0)))
    return F.element_at(F.array(*(F.lit(n) for n in order)), F.coalesce(F.array_max(place), F.lit(0)) + 1)


def log_matches(logs: DataFrame, rules: list[tuple[str, str, str]], text: str = "text") -> Column:
    """The rules (id, pattern, effect) that a log matches, as structs; the patterns are a parameter's, so few."""
    own = F.array(*(F.when(F.col(text).rlike("(?m)" + pattern), F.struct(F.lit(i).alias("rule"), F.lit(effect).alias("effect"))) for i, pattern, effect in rules))
    return F.array_compact(own)


def verdict(runs: DataFrame) -> DataFrame:
    """Completion state and outcome of worker runs.

    runs: termination (NORMAL, CRASH, TIMEOUT, ...), exit_code, cancelled, hung, declared (null without a
    manifest), engine_errors, n_expected, n_sound (expected outputs whose checksum holds), log_effects.
    """
    partial, invalid = F.lit("PARTIAL"), F.lit("INVALID")
    found = F.array_compact(F.array(
        F.when(F.col("termination") != "NORMAL", partial), F.when(F.col("exit_code") != 0, partial), F.when(F.col("declared").isNull(), invalid), F.col("declared"),
        F.when(F.col("engine_errors") > 0, partial), F.when(F.col("n_sound") < F.col("n_expected"), invalid),
    ))
    state = F.when(F.col("cancelled"), invalid).otherwise(worst(F.concat(found, F.coalesce("log_effects", F.array().cast("array<string>")))))
    out = runs.withColumn("completion", state)
    failed = F.when(F.col("termination").isin("CRASH", "TIMEOUT"), "RETRYABLE_FAILURE").otherwise("PERMANENT_FAILURE")
    outcome = F.when(F.col("cancelled"), "CANCELLED").when(F.col("hung"), "RETRYABLE_FAILURE").when(F.col("completion") == "COMPLETE", "SUCCESS").when(F.col("completion") == "PARTIAL", "PARTIAL").otherwise(failed)
    return out.withColumn("outcome", outcome)


def determinism(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two runs of the same nodes (key, class, sha256 of the bytes, canonical hash): D0 must repeat its bytes, others their content."""
    b = second.select(key, F.col("sha256").alias("_s"), F.col("canonical").alias("_c"))
    same = F.when(F.col("class") == "D0", F.col("sha256") == F.col("_s")).otherwise(F.col("canonical") == F.col("_c"))
    return first.join(b, key, "left").select(key, "class", F.coalesce(F.col("sha256") == F.col("_s"), F.lit(False)).alias("bit_identical"), F.coalesce(same, F.lit(False)).alias("match"))


def job_steps(states: DataFrame, job: str, *order: str) -> DataFrame:
    """Each state row of a job with the one before it and whether that step is allowed; a job begins QUEUED."""
    before = F.lag("state").over(Window.partitionBy(job).orderBy(*order))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, bs in JOB_STATES.items() for b in bs))
    out = states.withColumn("before", before)
    allowed = F.when(F.col("before").isNull(), F.col("state") == "QUEUED").otherwise(F.array_contains(steps, F.concat_ws(">", "before", "state")))
    return out.withColumn("allowed", allowed)


def recovered(jobs: DataFrame, alive: Column) -> DataFrame:
    """jobs (state) with `next`: what becomes of those that were at work when their owner died; null for the others."""
    dead = ~F.coalesce(alive, F.lit(False))
    step = F.when(F.col("state") == "CANCELLING", "CANCELLED").when(F.col("state") == "HUNG", "FAILED_RETRYABLE").when(F.col("state").isin(*ACTIVE), "INTERRUPTED")
    return jobs.withColumn("next", F.when(dead, step))


def health(checks: DataFrame, group: str) -> DataFrame:
    """Overall state of each group of checks (state): FAIL before WARN or NOT_AVAILABLE (both WARN) before OK."""
    rank = F.coalesce(*(F.when(F.col("state") == s, r) for s, r in HEALTH.items()), F.lit(2))
    return checks.groupBy(group).agg(F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), F.max(rank) + 1).alias("health"))
