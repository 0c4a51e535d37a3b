"""Change reports, report wording, benchmark truth and consensus details over the driver's tables.

Adapters: order = version of a customer's product, line item = file of a version, document = function,
conversation = lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, consensus, match, reports, truth
from ..session import table
from .analytics import CONSENSUS, FUNCTIONS, PROPOSALS, _consensus, _sides
from .relational import TRANSITIONS, _transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SIDES = f"""
 t AS MATERIALIZED ({TRANSITIONS}),
 s AS (SELECT l_orderkey AS v, l_returnflag AS role, l_linenumber AS ln, min(l_partkey) AS pk FROM lineitem GROUP BY ALL),
 m AS (SELECT v, role, map_from_entries(list((ln, pk))) AS secs FROM s WHERE ln <> 3 OR role <> 'A' GROUP BY ALL),
 g AS (SELECT l_orderkey AS v, l_returnflag AS role, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, list(DISTINCT l_suppkey) AS imports, list(DISTINCT l_partkey) AS strings, max(l_tax) AS linker, max(l_shipdate) AS stamp, bool_or(l_linestatus = 'F') AS signed, min(l_suppkey) FILTER (WHERE l_linestatus = 'F') AS signer, min(l_discount) FILTER (WHERE l_linestatus = 'O') AS pdb FROM lineitem GROUP BY ALL),
 c AS MATERIALIZED (SELECT g.*, m.secs, g.size > 10 AS image FROM g LEFT JOIN m USING (v, role)),
 lp AS MATERIALIZED (SELECT t.product, t."left", t."right", l.role, l FROM t JOIN c l ON l.v = t."left"),
 p AS (SELECT lp.product, lp."left", lp."right", lp.role, lp.l, r FROM lp JOIN c r ON r.v = lp."right" AND r.role = lp.role)"""


def _component_pairs(spark, sf_dir, steps: DataFrame | None = None) -> DataFrame:
    """Files of a role in neighbouring versions (or in those of steps), with what is known of each side.

    What else is to be known of a step comes with the steps, so that no facts are moved for it.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "v", "l_returnflag": "role"})
    secs = lines.groupBy("v", "role", "l_linenumber").agg(F.min("l_partkey").alias("pk")).where("l_linenumber <> 3 OR role <> 'A'")
    secs = secs.groupBy("v", "role").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "pk"))).alias("sections"))
    own = lines.groupBy("v", "role").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("size"), F.collect_set("l_suppkey").alias("imports"), F.collect_set("l_partkey").alias("strings"), F.max("l_tax").alias("linker"), F.max("l_shipdate").alias("timestamp"), F.max(F.col("l_linestatus") == "F").alias("signed"),
        F.min(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("signer"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("pdb"),
    )
    none = F.lit(None)
    own = own.join(secs, ["v", "role"], "left").withColumns({"image": F.col("size") > 10, "exports": none.cast("array<bigint>"), "resources": none.cast("array<bigint>"), "rich": none.cast("string")})
    facts = F.struct(*(c for c in own.columns if c not in ("v", "role")))
    left, right = own.select(F.col("v").alias("left"), "role", facts.alias("l")), own.select(F.col("v").alias("right"), "role", facts.alias("r"))
    steps = _transitions(spark, sf_dir) if steps is None else steps
    return steps.join(left, "left").join(right, ["right", "role"])


JOINED = "coalesce(array_to_string(list_sort({}), ','), '')"


@query(f"""WITH {SIDES}
 SELECT product, "left", "right", role, CASE WHEN l.secs IS NULL OR r.secs IS NULL THEN 'PARTIAL' ELSE 'MEASURED' END AS state, CAST(floor((r.size - l.size) / greatest(1, l.size) * 1000000 + 0.0001) AS BIGINT) AS size_delta_ppm,
  {JOINED.format("CASE WHEN l.secs IS NOT NULL AND r.secs IS NOT NULL THEN list_filter(map_keys(r.secs), lambda x: NOT list_contains(map_keys(l.secs), x)) END")} AS added, {JOINED.format("CASE WHEN l.secs IS NOT NULL AND r.secs IS NOT NULL THEN list_filter(map_keys(l.secs), lambda x: NOT list_contains(map_keys(r.secs), x)) END")} AS removed,
  {JOINED.format("list_filter(map_keys(l.secs), lambda x: list_contains(map_keys(r.secs), x) AND l.secs[x] <> r.secs[x])")} AS changed FROM p""")
def change_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and sections of each pair of files; sections that a side lacks make it PARTIAL."""
    b = changes.binary(F.col("l"), F.col("r"))
    out = _component_pairs(spark, sf_dir).select("product", "left", "right", "role", b.alias("b"))
    text = lambda c: F.coalesce(F.array_join(F.transform(F.col(f"b.sections_{c}"), lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return out.select("product", "left", "right", "role", "b.state", F.floor(F.col("b.size_delta_ratio") * 1000000 + 0.0001).cast("long").alias("size_delta_ppm"), text("added"), text("removed"), text("changed"))


@query(f"""WITH {SIDES}
 SELECT product, "left", "right", role, CASE WHEN l.image AND r.image THEN 'MEASURED' ELSE 'UNSUPPORTED' END AS state, CASE WHEN l.image AND r.image THEN l.linker IS DISTINCT FROM r.linker END AS linker_version_changed, CASE WHEN l.image AND r.image THEN l.stamp IS DISTINCT FROM r.stamp END AS timestamp_changed,
  CASE WHEN l.image AND r.image THEN l.signed <> r.signed END AS signature_presence_changed, CASE WHEN l.image AND r.image AND l.signed AND r.signed THEN l.signer <> r.signer END AS signer_changed,
  CASE WHEN l.image AND r.image AND (l.pdb IS NOT NULL OR r.pdb IS NOT NULL) THEN l.pdb IS DISTINCT FROM r.pdb END AS pdb_changed FROM p""")
def change_build(spark, sf_dir):
    """How each side was built: changed, not changed or not known."""
    out = _component_pairs(spark, sf_dir).select("product", "left", "right", "role", changes.build(F.col("l"), F.col("r")).alias("b"))
    return out.select("product", "left", "right", "role", "b.state", *(f"b.{c}" for c in ("linker_version_changed", "timestamp_changed", "signature_presence_changed", "signer_changed", "pdb_changed")))


@query(f"""WITH {SIDES}
 SELECT product, "left", "right", role, {JOINED.format("list_filter(r.imports, lambda x: NOT list_contains(l.imports, x))")} AS imports_added, {JOINED.format("list_filter(l.imports, lambda x: NOT list_contains(r.imports, x))")} AS imports_removed,
  CAST(len(list_filter(r.strings, lambda x: NOT list_contains(l.strings, x))) AS INT) AS strings_added, CAST(len(list_filter(l.strings, lambda x: NOT list_contains(r.strings, x))) AS INT) AS strings_removed FROM p""")
def change_semantic(spark, sf_dir):
    """Imports and strings that came and went."""
    out = _component_pairs(spark, sf_dir).select("product", "left", "right", "role", changes.semantic(F.col("l"), F.col("r")).alias("s"))
    text = lambda c: F.array_join(F.transform(F.col(f"s.{c}"), lambda x: x.cast("string")), ",").alias(c)
    return out.select("product", "left", "right", "role", text("imports_added"), text("imports_removed"), "s.strings_added", "s.strings_removed")


@query(f"""WITH {CONSENSUS}, f AS (SELECT lang AS component, doc_id AS address, md5(text) AS hash, len(string_split(text, chr(10))) AS cy FROM documents),
 ur AS (SELECT f.component, address FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.component = f.component AND c."right" = f.address)),
 d AS (SELECT c.component, c."right", r.cy - l.cy AS delta FROM c JOIN f l ON l.component = c.component AND l.address = c."left" JOIN f r ON r.component = c.component AND r.address = c."right" WHERE c.decision IN ('STRONG', 'PROBABLE') AND l.hash <> r.hash)
 SELECT n.component, functions_left, unresolved_left, coalesce(unresolved_right, 0) AS unresolved_right, coalesce(modified_functions, 0) AS modified_functions, CAST(coalesce(cyclomatic, 0) AS BIGINT) AS cyclomatic_delta_sum, CAST(coalesce(modified_functions, 0) * 1000000 // functions_left AS BIGINT) AS modified_ppm
 FROM (SELECT component, count(*) AS functions_left, count(*) FILTER (WHERE decision = 'UNRESOLVED') AS unresolved_left FROM c GROUP BY ALL) n LEFT JOIN (SELECT component, count(*) AS unresolved_right FROM ur GROUP BY ALL) USING (component) LEFT JOIN (SELECT component, count(DISTINCT "right") AS modified_functions, sum(delta) AS cyclomatic FROM d GROUP BY ALL) USING (component)""")
def change_structural(spark, sf_dir):
    """Modified and unresolved functions of each component; unresolved ones are neither removed nor new."""
    docs = table(spark, sf_dir, "documents")
    fn = docs.select(F.col("lang").alias("component"), F.col("doc_id").alias("address"), F.md5("text").alias("hash"), F.size(F.split("text", "\n")).alias("cyclomatic"))
    own = _consensus(spark, sf_dir).select("component", "left", "right", "decision", F.lit("left").alias("side"))
    only = consensus.unmatched_right(docs.select(F.col("lang").alias("component"), F.col("doc_id").alias("right")), own).select("component", F.lit(None).cast("long").alias("left"), "right", "decision", F.lit("right-only").alias("side"))
    out = changes.modified(own.unionByName(only), fn, fn)
    return out.select("component", "functions_left", "unresolved_left", "unresolved_right", "modified_functions", "cyclomatic_delta_sum", F.floor(F.col("modified_ratio") * 1000000 + 0.0001).cast("long").alias("modified_ppm"))


@query(f"""WITH {SIDES}, d AS (SELECT p.*, a.o_orderdate AS ld, CASE WHEN b.o_orderstatus <> 'P' THEN b.o_orderdate END AS rd, a.o_orderstatus <> 'O' AS seen, CAST(floor((b.o_orderkey % 10) / 10.0 * 10) AS INT) AS cov, b.o_orderkey % 4 AS miss FROM p JOIN orders a ON a.o_orderkey = "left" JOIN orders b ON b.o_orderkey = "right")
 SELECT product, "left", "right", role, dimension, CASE dimension WHEN 'BINARY' THEN CASE WHEN l.secs IS NULL OR r.secs IS NULL THEN 'PARTIAL' ELSE 'MEASURED' END WHEN 'BUILD' THEN CASE WHEN l.image AND r.image THEN 'MEASURED' ELSE 'UNSUPPORTED' END
   WHEN 'DEPLOYMENT' THEN CASE WHEN NOT seen THEN 'NOT_MEASURED' WHEN rd IS NULL THEN 'PARTIAL' ELSE 'MEASURED' END WHEN 'ECOSYSTEM' THEN CASE WHEN seen AND rd IS NOT NULL THEN 'MEASURED' ELSE 'NOT_MEASURED' END ELSE 'MEASURED' END AS state,
  CASE WHEN cov < 6 THEN 'LOW' WHEN miss > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS reliability FROM d, unnest(['BINARY', 'BUILD', 'STRUCTURAL', 'SEMANTIC', 'DEPLOYMENT', 'ECOSYSTEM', 'ANALYSIS_RELIABILITY']) AS u(dimension)""")
def change_report(spark, sf_dir):
    """Seven rows for each pair of components: what was measured of each dimension and how far it can be relied on."""
    o = table(spark, sf_dir, "orders")
    left = o.select(F.col("o_orderkey").alias("left"), F.to_date("o_orderdate").alias("ld"), F.when(F.col("o_orderstatus") != "O", 1).otherwise(0).alias("nl"))
    right = o.select(F.col("o_orderkey").alias("right"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("rd"), ((F.col("o_orderkey") % 10) / 10).alias("coverage"), (F.col("o_orderkey") % 4).alias("missing"))
    pairs = _component_pairs(spark, sf_dir, _transitions(spark, sf_dir).join(left, "left").join(right, "right"))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    b, u, s, d = changes.binary(l, r), changes.build(l, r), changes.semantic(l, r), changes.deployment(F.col("ld"), F.col("rd"), F.col("nl"), F.lit(1))
    known = (F.col("nl") > 0) & F.col("rd").isNotNull()
    level = changes.reliability_level(F.col("coverage"), F.col("missing"), F.lit(None).cast("double"), F.lit(0))
    dims = {
        "BINARY": (b["state"], b), "BUILD": (u["state"], u), "STRUCTURAL": (F.lit("MEASURED"), F.struct((r["size"] - l["size"]).alias("size"))), "SEMANTIC": (s["state"], s), "DEPLOYMENT": (d["state"], d),
        "ECOSYSTEM": (F.when(known, "MEASURED").otherwise("NOT_MEASURED"), F.struct(F.lit(0).alias("events"))), "ANALYSIS_RELIABILITY": (F.lit("MEASURED"), F.struct("coverage", "missing")),
    }
    return changes.change_rows(pairs, ["product", "left", "right", "role"], dims, level).select("product", "left", "right", "role", "dimension", "state", "reliability")


@query("""SELECT p_partkey, CASE WHEN p_size < 6 OR (p_size % 7 <> 0 AND p_size % 11 < 4) THEN 'LOW' WHEN p_size % 3 > 0 OR (p_size % 7 <> 0 AND p_size % 11 < 8) OR p_size % 5 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM part""")
def reliability_levels(spark, sf_dir):
    """Levels by coverage, missing evidence, extraction and unverified engines; unknown extraction lowers nothing."""
    n = F.col("p_size")
    extraction = F.when(n % 7 != 0, F.when(n % 11 < 4, 0.4).when(n % 11 < 8, 0.8).otherwise(0.95))
    return table(spark, sf_dir, "part").select("p_partkey", changes.reliability_level(n / 10, n % 3, extraction, F.when(n % 5 == 1, 1).otherwise(0)).alias("level"))


@query(f"""WITH {CONSENSUS}, offered AS (SELECT DISTINCT lang AS component, doc_id AS "left", doc_id + 20 * (e + 1) AS other, (doc_id * 7 + e * 13) % 20 / 20.0 AS score FROM documents, (VALUES (0), (1), (2), (3)) AS t(e) WHERE (doc_id + e) % 5 <> 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY component, "left" ORDER BY score DESC, other) AS n FROM offered), b AS (SELECT component, "left", string_agg(other, ',' ORDER BY n) AS candidates FROM k WHERE n <= 3 GROUP BY ALL)
 SELECT c.component, c."left", coalesce(candidates, '') AS candidates, CASE WHEN un."left" IS NOT NULL THEN 'e9' ELSE '' END AS no_counterpart FROM c LEFT JOIN b USING (component, "left") LEFT JOIN un USING (component, "left") WHERE c."right" IS NULL""")
def consensus_unresolved(spark, sf_dir):
    """Unmatched left functions with their best candidates and the engines that claim no counterpart."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("component"), F.col("doc_id").alias("left"))
    offers = docs.withColumn("e", F.explode(F.array(*map(F.lit, range(4))))).where("(left + e) % 5 <> 0").select("component", "left", (F.col("left") + 20 * (F.col("e") + 1)).alias("other"), (((F.col("left") * 7 + F.col("e") * 13) % 20) / 20).alias("score"))
    out = consensus.unresolved_left(_consensus(spark, sf_dir), offers, docs.where("left % 11 = 0").withColumn("engine", F.lit("e9")))
    return out.select("component", "left", F.array_join(F.transform("candidates", lambda c: c["other"].cast("string")), ",").alias("candidates"), F.array_join("no_counterpart", ",").alias("no_counterpart"))


@query(f"""WITH {PROPOSALS}, g AS (SELECT component, list(DISTINCT engine) AS e, list_distinct(flatten(list(families))) AS f FROM p GROUP BY ALL)
 SELECT component, array_to_string(list_filter(['e0', 'e1', 'e2', 'e7'], lambda x: NOT list_contains(e, x)), ',') AS missing_engines, array_to_string(list_filter(['identity', 'instruction', 'cfg', 'callgraph', 'data-reference', 'semantic', 'historical-lineage'], lambda x: NOT list_contains(f, x)), ',') AS missing_families FROM g""")
def consensus_missing(spark, sf_dir):
    """Engines that gave nothing and families that none measured."""
    i, e = F.col("doc_id"), F.col("e")
    bits = i + e * 3 + F.floor(i / 7)
    families = F.array_compact(F.array(*(F.when(F.shiftright(bits, k) % 2 == 1, f) for k, f in enumerate(("cfg", "instruction", "identity", "callgraph")))))
    own = table(spark, sf_dir, "documents").withColumn("e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((i + e) % 4 != 0)
    own = own.select(F.col("lang").alias("component"), F.concat(F.lit("e"), e.cast("string")).alias("engine"), families.alias("families_used"))
    return consensus.missing(own, ["e2", "e1", "e0", "e7"]).select("component", F.array_join("missing_engines", ",").alias("missing_engines"), F.array_join("missing_families", ",").alias("missing_families"))


HIST = "list_transform(list_distinct({0}.w), lambda x: {0}.hist[x])"


@query(f"""WITH {FUNCTIONS.replace("list_distinct(string_split(text, chr(10))) AS lines", "list_distinct(string_split(text, chr(10))) AS lines, list_histogram_ AS hist, len(string_split(text, chr(10))) AS blocks, list_distinct(list_filter(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> ''), lambda w: length(w) >= 12)) AS imports").replace("list_histogram_", "list_aggregate(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> ''), 'histogram')")},
 x AS (SELECT l.component, l.entry AS "left", r.entry AS "right", l.h = r.h AND l.n > 0 AND r.n > 0 AS same, list_sum(list_transform(map_keys(l.hist), lambda k: coalesce(r.hist[k], 0) * l.hist[k])) AS dot, list_sum(list_transform(map_values(l.hist), lambda v: v * v)) AS nl, list_sum(list_transform(map_values(r.hist), lambda v: v * v)) AS nr,
   1 - abs(l.n - r.n) / greatest(l.n, r.n, 1) AS ratio, 1 - abs(l.blocks - r.blocks) / greatest(l.blocks, r.blocks, 1) AS rb, len(list_distinct(l.w)) AS el, len(list_distinct(r.w)) AS er, l.blocks AS bl, r.blocks AS br,
   len(list_intersect(l.imports, r.imports)) AS ii, len(l.imports) + len(r.imports) - len(list_intersect(l.imports, r.imports)) AS iu, len(list_intersect(l.lines, r.lines)) AS si, len(l.lines) + len(r.lines) - len(list_intersect(l.lines, r.lines)) AS su, l.name AS ln, r.name AS rn
   FROM l JOIN r ON l.component = r.component AND r.entry = l.entry + 20),
 y AS (SELECT component, "left", "right", round(CASE WHEN same THEN 1.0 ELSE coalesce(dot / nullif(sqrt(nl) * sqrt(nr), 0), 0) * sqrt(ratio) END, 4) AS i, round(0.3 * (rb + (1 - abs(el - er) / greatest(el, er, 1)) + (1 - abs(greatest(1, el - bl + 2) - greatest(1, er - br + 2)) / greatest(1, el - bl + 2, er - br + 2))), 4) AS c, round(coalesce((ii / nullif(iu, 0) + 1) / 2, 1), 4) AS g, round(si / nullif(su, 0), 4) AS d, CASE WHEN ln IS NOT NULL AND rn IS NOT NULL THEN (ln = rn)::INT::DOUBLE END AS n FROM x)
 SELECT component, "left", "right", CAST(floor(i * 1000 + 0.5) AS BIGINT) AS instruction, CAST(floor(c * 1000 + 0.5) AS BIGINT) AS cfg, CAST(floor(g * 1000 + 0.5) AS BIGINT) AS callgraph, CAST(floor(d * 1000 + 0.5) AS BIGINT) AS data, CAST(n AS BIGINT) AS identity,
  CAST(floor(round((0.35 * i + 0.25 * c + 0.15 * g + coalesce(0.15 * d, 0) + coalesce(0.1 * n, 0)) / (0.75 + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END + CASE WHEN n IS NULL THEN 0 ELSE 0.1 END), 4) * 100 + 0.5) AS BIGINT) AS score FROM y""")
def matcher_families(spark, sf_dir):
    """All five families of neighbouring functions and the mean of those that say something."""
    left, right = _sides(spark, sf_dir)
    linked = F.array().cast("array<bigint>").alias("linked")
    own = lambda f, n: f.select("component", F.struct(*(c for c in f.columns if c != "component"), linked).alias(n))
    pairs = own(left, "l").withColumn("k", F.col("l.entry") + 20).join(own(right, "r").withColumn("k", F.col("r.entry")), ["component", "k"])
    out = match.scored(pairs)
    scale = lambda c, k: F.floor(F.col(f"`{c}`") * k + 0.5).cast("long")
    return out.select("component", "left", "right", scale("instruction", 1000).alias("instruction"), scale("cfg", 1000).alias("cfg"), scale("callgraph", 1000).alias("callgraph"), scale("data-reference", 1000).alias("data"), F.col("identity").cast("long").alias("identity"), scale("score", 100).alias("score"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 4 > 0 THEN 'cfg:' || (p_size >= 25) END, CASE WHEN p_size % 3 > 0 THEN 'identity:' || (p_size % 2 = 1) END, 'instruction:' || (p_size <= 26)) AS evidence FROM part""")
def matcher_evidence(spark, sf_dir):
    """Measured families of a match and whether each supports it."""
    n = F.col("p_size")
    fam = {"instruction": (51 - n) / 50, "cfg": F.when(n % 4 > 0, n / 50), "identity": F.when(n % 3 > 0, (n % 2).cast("double"))}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(match.evidence(fam), lambda e: F.concat_ws(":", e["family"], e["supports"].cast("string"))), ",").alias("evidence"))


RELATIONS = ("CONTINUATION", "MODIFIED", "RESURRECTED_CONFIRMED", "RESURRECTED_CANDIDATE", "SPLIT_PARENT", "MERGE_PARENT", "DISAPPEARED", "UNRESOLVED")
DECISIONS = ("EXACT", "STRONG", "PROBABLE", "AMBIGUOUS", "CONFLICT", "UNRESOLVED", "ABSTAIN")
EVENTS = f"""ev AS (SELECT doc_id, {list(RELATIONS)}[1 + doc_id % 8] AS relation, {list(DECISIONS)}[1 + doc_id // 8 % 7] AS decision FROM documents),
 inf AS (SELECT *, CASE WHEN relation IN ('CONTINUATION', 'MODIFIED') THEN CASE decision WHEN 'EXACT' THEN 'CONFIRMED_BY_RULE' WHEN 'CONFLICT' THEN 'CONFLICTING' ELSE decision END WHEN relation = 'RESURRECTED_CONFIRMED' THEN 'CONFIRMED_BY_RULE'
   WHEN relation IN ('RESURRECTED_CANDIDATE', 'SPLIT_PARENT', 'MERGE_PARENT') THEN 'HYPOTHESIS' WHEN relation = 'DISAPPEARED' THEN 'NOT_OBSERVED' ELSE 'UNRESOLVED' END AS state FROM ev)"""


def _events(spark, sf_dir) -> DataFrame:
    pick = lambda xs, n: F.get(F.array(*(F.lit(x) for x in xs)), n.cast("int"))
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", pick(RELATIONS, i % 8).alias("relation"), pick(DECISIONS, F.floor(i / 8) % 7).alias("decision"))


@query(f"WITH {EVENTS} SELECT doc_id, relation, state AS inference_state, state = 'HYPOTHESIS' AS is_hypothesis FROM inf")
def lineage_inference(spark, sf_dir):
    """How sure a report may be of each lineage event, and whether its words say so."""
    own = _events(spark, sf_dir)
    state = reports.lineage_inference(F.col("relation"), F.col("decision"))
    said = reports.lineage_status(F.col("relation"), F.col("decision"))
    return own.select("doc_id", "relation", state.alias("inference_state"), said.contains("hypothesis").alias("is_hypothesis"))


@query(f"WITH {EVENTS} SELECT state AS inference_state, relation, count(*) AS n FROM inf GROUP BY ALL")
def inference_counts(spark, sf_dir):
    """Events of a report by relation and level."""
    own = _events(spark, sf_dir).withColumn("inference_state", reports.lineage_inference(F.col("relation"), F.col("decision")))
    return own.groupBy("inference_state", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS} SELECT doc_id, problem FROM (SELECT doc_id, unnest(list_filter([CASE WHEN relation NOT IN ('CONTINUATION', 'MODIFIED') AND doc_id % 5 = 0 AND state <> 'STRONG' THEN 'relation shown as another level' END, CASE WHEN doc_id % 11 = 0 THEN 'a probability is printed' END], lambda x: x IS NOT NULL)) AS problem FROM inf)""")
def report_invariants(spark, sf_dir):
    """Claims that a report must not make, found where they are planted."""
    own = _events(spark, sf_dir)
    state = reports.lineage_inference(F.col("relation"), F.col("decision"))
    confirmed = reports.lineage_explanation(F.col("relation"), F.lit("exact"), F.array(F.lit("data")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    rows = own.select("doc_id", F.lit("event").alias("kind"), "decision", "relation", F.when(F.col("doc_id") % 5 == 0, "STRONG").otherwise(state).alias("inference_state"), reports.lineage_status(F.col("relation"), F.col("decision")).alias("status_text"), confirmed.alias("explanation"), F.when(F.col("doc_id") % 11 == 0, 0.5).alias("probability"))
    found = reports.invariant_problems(rows.withColumn("inference_state", F.when(F.col("relation").isin("CONTINUATION", "MODIFIED"), reports.inference(F.col("decision"))).otherwise(F.col("inference_state"))))
    return found.select("doc_id", "problem")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'COMPLETED_PARTIAL' ELSE 'UNKNOWN' END AS run_status, o_orderstatus = 'O' OR o_orderkey % 3 = 1 AS is_partial FROM orders")
def run_completeness(spark, sf_dir):
    """What a banner says of each run: partial if it is, or if evidence is missing."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "COMPLETED_PARTIAL")
    own = table(spark, sf_dir, "orders").select("o_orderkey", reports.completeness(status, F.when(F.col("o_orderkey") % 3 == 1, 2)).alias("c"))
    return own.select("o_orderkey", "c.run_status", "c.is_partial")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN CAST(floor(o_totalprice) - o_custkey AS BIGINT) END AS delta FROM orders")
def guarded_delta(spark, sf_dir):
    """Differences between runs that compare fully."""
    state = F.when(F.col("o_orderstatus") == "F", "FULL").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("NONE")
    own = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("comparability"), F.col("o_custkey").alias("a"), F.when(F.col("o_totalprice") > 1000, F.floor("o_totalprice")).alias("b"))
    return reports.compared(own).select("o_orderkey", F.col("delta").cast("long").alias("delta"))


@query("SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'CALIBRATED' ELSE 'OUT_OF_DISTRIBUTION' END AS calibration_state FROM part")
def calibration_of_rows(spark, sf_dir):
    """Whether a validated calibration covers the context of each row."""
    part = table(spark, sf_dir, "part").withColumn("context", F.col("p_brand"))
    profiles = part.select("context", (F.col("p_size") == 1).alias("validated"))
    return reports.calibration_state(part, profiles).select("p_partkey", "calibration_state")


@query(f"""WITH {CONSENSUS}, k AS (SELECT component, "left", string_agg(engine || ':' || decision, ',' ORDER BY engine, decision) AS raw FROM p GROUP BY ALL) SELECT c.component, c."left", c.decision, coalesce(raw, '') AS raw FROM c LEFT JOIN k USING (component, "left")""")
def match_evidence(spark, sf_dir):
    """Each match with what every engine said of its left function."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("run"), F.col("doc_id").alias("left"))
    i, e = F.col("left"), F.col("e")
    decisions = F.array(*(F.lit(d) for d in ("EXACT", "STRONG", "PROBABLE", "AMBIGUOUS", "UNRESOLVED")))
    raw = docs.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((i + e) % 4 != 0)
    raw = raw.select("run", "left", F.concat(F.lit("e"), e.cast("string")).alias("engine"), F.get(decisions, ((i * 3 + e * 5 + F.floor(i / 40)) % 5).cast("int")).alias("decision"), F.lit(0.5).alias("raw_score"))
    out = reports.evidence_of(_consensus(spark, sf_dir).withColumnRenamed("component", "run"), raw)
    text = F.array_join(F.transform("raw_results", lambda x: F.concat_ws(":", x["engine"], x["decision"])), ",")
    return out.select(F.col("run").alias("component"), "left", "decision", F.coalesce(text, F.lit("")).alias("raw"))


@query(f"""WITH t AS ({TRANSITIONS}), o AS (SELECT o_custkey AS product, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), r AS (SELECT * FROM (VALUES (3), (6)) AS v(k))
 SELECT t.product, "left", "right", max(k) AS run FROM t JOIN o a ON a.o_orderkey = "left" LEFT JOIN r ON a.n + 1 <= k AND (k = 3 OR a.n % 2 = 1) GROUP BY ALL""")
def covering_lineage_run(spark, sf_dir):
    """The latest lineage run that goes directly from one version to the next: of the first three versions, or of the first six in swapped pairs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))
    runs = None
    for k in (3, 6):
        place = F.col("n") if k == 3 else F.floor((F.col("n") - 1) / 2) * -2 + (F.col("n") - 1) % 2  # pairs in reverse order
        own = o.where(F.col("n") <= k).groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"]).alias("builds")).withColumn("run", F.lit(k)).withColumn("seq", F.lit(k))
        runs = own if runs is None else runs.unionByName(own)
    return reports.covering_run(runs, _transitions(spark, sf_dir)).select("product", "left", "right", "run")


@query("""SELECT conv_id AS lineage, turn AS build, CASE role WHEN 'user' THEN 'STRONG' WHEN 'assistant' THEN 'HYPOTHESIS' ELSE 'UNRESOLVED' END AS inference_state, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn) AS INT) AS place, CASE WHEN turn % 2 = 0 THEN 'f' || turn END AS name FROM conversations""")
def lineage_history(spark, sf_dir):
    """A lineage's events in order, each with the level that a report gives it."""
    own = table(spark, sf_dir, "conversations")
    fn = F.col("conv_id") * 1000 + F.col("turn")
    relation = F.when(F.col("role") == "user", "MODIFIED").when(F.col("role") == "assistant", "SPLIT_PARENT").otherwise("UNRESOLVED")
    assigned = own.select(F.lit("p").alias("product"), F.col("conv_id").alias("lineage"), F.col("turn").alias("build"), fn.alias("fn"), relation.alias("relation"), F.lit("STRONG").alias("decision"), F.col("turn").alias("step"))
    names = own.where("turn % 2 = 0").select(F.lit("p").alias("product"), fn.alias("fn"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("name"))
    return reports.events_of(assigned, names).select("lineage", "build", "inference_state", "place", "name")


TRUTH = f"""{CONSENSUS},
 tr AS (SELECT component, "left", "right", bool_or(kind = 'pair') AS required FROM (SELECT lang AS component, doc_id AS "left", doc_id + 20 AS "right", 'pair' AS kind FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT lang, doc_id, doc_id + 40, 'split' FROM documents WHERE doc_id % 5 = 0) GROUP BY ALL),
 kn AS (SELECT DISTINCT component, "left" FROM tr), ex AS (SELECT lang AS component, doc_id AS address FROM documents WHERE n_chars > 60),
 ro AS (SELECT lang AS component, doc_id AS "right" FROM documents WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.component = lang AND c."right" = doc_id)),
 pr AS (SELECT DISTINCT component, "left", "right" FROM c SEMI JOIN kn USING (component, "left") WHERE decision IN ('EXACT', 'STRONG', 'PROBABLE') AND "right" IS NOT NULL),
 tu AS (SELECT tr.*, l.address IS NOT NULL AND r.address IS NOT NULL AS usable, ro."right" IS NOT NULL AS new FROM tr LEFT JOIN ex l ON l.component = tr.component AND l.address = tr."left" LEFT JOIN ex r ON r.component = tr.component AND r.address = tr."right" LEFT JOIN ro ON ro.component = tr.component AND ro."right" = tr."right"),
 sc AS (SELECT component, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE required AND NOT p) AS fn, count(*) FILTER (WHERE required AND usable) AS usable, count(*) FILTER (WHERE required AND usable AND new) AS false_new
  FROM (SELECT component, coalesce(required, FALSE) AS required, coalesce(usable, FALSE) AS usable, coalesce(new, FALSE) AS new, pr2.p IS NOT NULL AS p, tu.required IS NOT NULL AS t FROM (SELECT *, TRUE AS p FROM pr) pr2 FULL JOIN tu USING (component, "left", "right")) GROUP BY ALL),
 co AS (SELECT kn.component, count(*) FILTER (WHERE ex.address IS NOT NULL) AS found, count(*) AS n FROM kn LEFT JOIN ex ON ex.component = kn.component AND ex.address = kn."left" GROUP BY ALL)"""


def _truth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("component"), F.col("doc_id").alias("left"), "n_chars")
    pairs = docs.where("left % 3 < 2").select("component", "left", (F.col("left") + 20).alias("right"), F.lit("pair").alias("kind"))
    splits = docs.where("left % 5 = 0").select("component", "left", (F.col("left") + 40).alias("right"), F.lit("split").alias("kind"))
    return docs, truth.required_pairs(pairs.unionByName(splits))


def _scored_transitions(spark, sf_dir) -> DataFrame:
    docs, wanted = _truth(spark, sf_dir)
    matches = _consensus(spark, sf_dir)
    there = docs.where("n_chars > 60").select("component", F.col("left").alias("address"))
    extracted = there.withColumn("side", F.lit("left")).unionByName(there.withColumn("side", F.lit("right")))
    only = consensus.unmatched_right(docs.select("component", F.col("left").alias("right")), matches)
    return truth.transition(matches, wanted, extracted, only, "component")


@query(f"""WITH {TRUTH} SELECT component, tp, fp, fn, false_new, CAST(tp * 1000000 // nullif(tp + fp, 0) AS BIGINT) AS p_ppm, CAST(tp * 1000000 // nullif(tp + fn, 0) AS BIGINT) AS r_ppm, CAST(found * 1000000 // n AS BIGINT) AS coverage_ppm, CAST(false_new * 1000000 // nullif(usable, 0) AS BIGINT) AS false_new_ppm FROM sc JOIN co USING (component)""")
def truth_transition(spark, sf_dir):
    """Consensus against the truth: what was found, missed, wrong, and falsely left as new."""
    ppm = lambda c: F.floor(F.col(c) * 1000000 + 0.0001).cast("long")
    return _scored_transitions(spark, sf_dir).select("component", "tp", "fp", "fn", "false_new", ppm("precision").alias("p_ppm"), ppm("recall").alias("r_ppm"), ppm("coverage").alias("coverage_ppm"), ppm("false_new_rate").alias("false_new_ppm"))


@query(f"""WITH {TRUTH} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(false_new) AS BIGINT) AS false_new, CAST(floor(avg(found / n) * 1000000 + 0.0001) AS BIGINT) AS coverage_ppm, CAST(floor(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) * 1000000 + 0.0001) AS BIGINT) AS f1_ppm FROM sc JOIN co USING (component)""")
def truth_totals(spark, sf_dir):
    """Totals of a benchmark over its transitions."""
    out = truth.totals(_scored_transitions(spark, sf_dir))
    ppm = lambda c: F.floor(F.col(c) * 1000000 + 0.0001).cast("long")
    return out.select("tp", "fp", "fn", "false_new", ppm("coverage").alias("coverage_ppm"), ppm("f1").alias("f1_ppm"))


@query(f"""WITH {TRUTH} SELECT c.component, c.decision, count(*) AS n, count(tr."left") AS correct FROM c LEFT JOIN tr ON tr.component = c.component AND tr."left" = c."left" AND tr."right" = c."right" WHERE c."right" IS NOT NULL GROUP BY ALL""")
def truth_by_class(spark, sf_dir):
    """How often each decision is right."""
    return truth.class_precision(_consensus(spark, sf_dir).where("right IS NOT NULL"), _truth(spark, sf_dir)[1], "component")


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20 AND a.lang = b.lang WHERE a.doc_id % 7 < 5), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(v, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a) SELECT v, min(w) AS logical FROM r GROUP BY v""")
def logical_functions(spark, sf_dir):
    """Logical functions of the truth: what pairs connect over all versions."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("v"), "lang")
    pairs = docs.where("v % 7 < 5").select(F.col("v").alias("a"), (F.col("v") + 20).alias("b"), "lang").join(docs.withColumnRenamed("v", "b"), ["b", "lang"]).select("a", "b")
    return truth.logical_functions(docs, pairs)


QUALITY = """
 d AS (SELECT doc_id AS v, doc_id // 20 % 4 AS version, lang || ':' || doc_id % 20 || ':' || doc_id // 80 AS logical, CASE WHEN doc_id % 13 = 0 THEN 'shared' || doc_id // 80 % 2 ELSE lang || ':' || doc_id % 20 || ':' || doc_id // 80 || CASE WHEN doc_id % 3 = 0 AND doc_id // 20 % 4 > 1 THEN '+' ELSE '' END END AS lineage FROM documents),
 a AS (SELECT * FROM d WHERE v % 17 > 0), lk AS (SELECT DISTINCT rtrim(lineage, '+') AS parent, lineage AS child, CASE WHEN v % 2 = 0 THEN 'RESURRECTED_CANDIDATE' ELSE 'SPLIT_PARENT' END AS relation FROM d WHERE ends_with(lineage, '+') AND v % 5 > 0),
 isl AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM lk WHERE child = a.lineage) THEN rtrim(a.lineage, '+') ELSE a.lineage END AS island FROM a),
 ln AS (SELECT lineage, count(DISTINCT logical) AS d FROM a GROUP BY ALL), lg AS (SELECT logical, count(DISTINCT lineage) AS d, count(DISTINCT island) AS i, count(DISTINCT version) AS got FROM isl GROUP BY ALL), wa AS (SELECT logical FROM d GROUP BY ALL HAVING count(DISTINCT version) = 4),
 fc AS (SELECT count(*) AS n FROM lk WHERE relation = 'RESURRECTED_CANDIDATE' AND NOT EXISTS (SELECT 1 FROM a x JOIN a y USING (logical) WHERE x.lineage = parent AND y.lineage = child))"""


def _quality(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = F.col("doc_id")
    part = lambda c: c.cast("string")
    logical = F.concat_ws(":", "lang", part(v % 20), part(F.floor(v / 80)))
    plus = F.when((v % 3 == 0) & (F.floor(v / 20) % 4 > 1), "+").otherwise("")
    lineage = F.when(v % 13 == 0, F.concat(F.lit("shared"), part(F.floor(v / 80) % 2))).otherwise(F.concat(logical, plus))
    d = table(spark, sf_dir, "documents").select(v.alias("v"), (F.floor(v / 20) % 4).alias("version"), logical.alias("logical"), lineage.alias("lineage"))
    split = d.where(F.col("lineage").endswith("+") & (F.col("v") % 5 > 0))
    links = split.select(F.rtrim("lineage", F.lit("+")).alias("parent"), F.col("lineage").alias("child"), F.when(F.col("v") % 2 == 0, "RESURRECTED_CANDIDATE").otherwise("SPLIT_PARENT").alias("relation")).distinct()
    return d, d.where("v % 17 > 0").select("lineage", "version", "v"), links


@query(f"""WITH {QUALITY} SELECT (SELECT count(*) FROM ln) AS lineages, (SELECT count(*) FROM ln WHERE d > 1) AS wrong_merge, (SELECT count(*) FROM lg WHERE d > 1) AS wrong_split, (SELECT count(*) FROM lg WHERE i > 1) AS wrong_split_unlinked, (SELECT count(*) FROM wa) AS full_chains,
  (SELECT count(*) FROM wa JOIN lg USING (logical) WHERE d = 1) AS recovered, (SELECT count(*) FROM wa JOIN lg USING (logical) WHERE i = 1) AS recovered_linked, (SELECT count(*) FROM wa JOIN lg USING (logical) WHERE d = 1 AND got = 4) AS recovered_strict, (SELECT n FROM fc) AS false_resurrection_candidates""")
def lineage_scores(spark, sf_dir):
    """Lineages against the truth: merged, split, split but linked, recovered."""
    logical, assigned, links = _quality(spark, sf_dir)
    out = truth.lineage_scores(assigned, logical.select("v", "version", "logical"), links, 4)
    return out.select("lineages", "wrong_merge", "wrong_split", "wrong_split_unlinked", "full_chains", "recovered", "recovered_linked", "recovered_strict", "false_resurrection_candidates")


@query(f"""WITH {QUALITY} SELECT d.v, CASE WHEN lg.d = 1 THEN 'confirmed' WHEN lg.i = 1 THEN 'candidate_linked' ELSE 'missed' END AS outcome FROM d LEFT JOIN lg USING (logical) WHERE version = 3""")
def return_outcomes(spark, sf_dir):
    """What became of each true return."""
    logical, assigned, links = _quality(spark, sf_dir)
    return truth.return_outcomes(logical.where("version = 3").select("v"), logical.select("v", "logical"), assigned, links)
