"""Stores, plans and the state of runs over the driver's tables.

Adapters: order = run, node or result, line item = a file of a version, part = artifact, event = job
state or check, document = stored blob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import planning, retention, store
from ..operators.planning import Spec
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, CAST(1000 + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows numbered after the last sequence number."""
    return store.numbered(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id", start=1000).select("event_id", F.col("seq").cast("long").alias("seq"))


RELEASES = "o AS (SELECT o_custkey % 50 AS product, nullif(o_orderpriority, '5-LOW') AS channel, o_orderkey FROM orders)"


def _releases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("product"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("channel"), "o_orderkey")


@query(f"""WITH {RELEASES}, k AS (SELECT product, channel, min('r' || o_orderkey) AS release FROM o WHERE o_orderkey % 7 = 0 GROUP BY ALL)
 SELECT a.product, a.channel, k.release, k.release IS NULL AS created FROM (SELECT DISTINCT product, channel FROM o) a LEFT JOIN k ON a.product = k.product AND a.channel IS NOT DISTINCT FROM k.channel""")
def release_get_or_create(spark, sf_dir):
    """Releases that exist (each seventh row) keep their id, the others get one; a null channel is a channel."""
    own = _releases(spark, sf_dir)
    known = own.where("o_orderkey % 7 = 0").select("product", "channel", F.concat(F.lit("r"), "o_orderkey").alias("release"))
    out = store.get_or_create(known, own, ["product", "channel"], "release")
    return out.select("product", "channel", F.when(~F.col("created"), F.col("release")).alias("release"), "created")


@query(f"""WITH {RELEASES} SELECT product, channel, min(o_orderkey) AS o_orderkey FROM o a WHERE NOT EXISTS (SELECT 1 FROM o k WHERE k.o_orderkey % 7 = 0 AND k.product = a.product AND k.channel IS NOT DISTINCT FROM a.channel) GROUP BY ALL""")
def insert_ignoring_known(spark, sf_dir):
    """The rows that a repeated import would still append: one for each new key."""
    own = _releases(spark, sf_dir)
    return store.insert_new(own.where("o_orderkey % 7 = 0").select("product", "channel"), own, ["product", "channel"], "o_orderkey").select("product", "channel", "o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('error', 'purchase')) WHERE n = 1 AND event_type = 'purchase'")
def soft_delete_view(spark, sf_dir):
    """What is not in the trash: an error deletes, a purchase restores, the last one counts."""
    own = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))
    return store.current(own, ["user_id"], F.desc("ts"), F.desc("event_id"), deleted="deleted_at").select("user_id", "event_id")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'type' END, CASE WHEN NOT (value >= 0 AND value < 100) THEN 'value' END,
  CASE WHEN NOT coalesce(CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0, FALSE) THEN 'props' END], lambda x: x IS NOT NULL), ',') AS problems FROM events""")
def vocabulary_check(spark, sf_dir):
    """Rows against closed vocabularies, bounds and the shape of their document; nothing is dropped."""
    key = canonical.dotted(F.col("props"), "k").try_cast("int")
    rules = {"type": F.col("event_type").isin("view", "click", "purchase"), "value": (F.col("value") >= 0) & (F.col("value") < 100), "props": key % 2 == 0}
    return store.checked(table(spark, sf_dir, "events"), rules).select("event_id", F.array_join("problems", ",").alias("problems"))


@query("""
WITH l AS (SELECT l_orderkey AS version, coalesce(CASE WHEN p_size < 3 THEN 'OTHER' END, l_returnflag || l_linestatus) AS role, l_partkey AS artifact FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
f AS (SELECT artifact, min(version) AS first FROM l GROUP BY ALL),
s AS (SELECT version, count(*) AS n_files, count(DISTINCT artifact) AS n_artifacts, count(DISTINCT CASE WHEN first = version THEN artifact END) AS n_new, string_agg(role || chr(9) || artifact, chr(10) ORDER BY role || chr(9) || artifact) AS fp FROM l JOIN f USING (artifact) GROUP BY ALL)
SELECT version, n_files, n_artifacts, n_new, nullif(min(version) OVER (PARTITION BY fp), version) AS duplicate_of FROM s
""")
def import_preview(spark, sf_dir):
    """What each version would bring: new artifacts, and the earlier version that has the same ones in the same roles."""
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), F.concat("l_returnflag", "l_linestatus").alias("role"), F.col("l_partkey").alias("artifact"))
    overrides = table(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_partkey").alias("artifact"), F.lit("OTHER").alias("override"))
    return store.import_plan(files, "version", [], "role", "artifact", overrides).select("version", "n_files", "n_artifacts", "n_new", "duplicate_of")


STORED = "st AS (SELECT doc_id, source, n_chars > 60 AS there, CASE WHEN NOT n_chars > 60 THEN 'MISSING' WHEN lang = 'de' THEN 'CORRUPTED' ELSE 'AVAILABLE' END AS state FROM documents)"


def _integrity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("lang") == "de", "x").otherwise("")), 256).alias("sha256"))
    return store.integrity(stored, docs.where("n_chars > 60").select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id")


@query(f"WITH {STORED} SELECT doc_id, state FROM st")
def artifact_integrity(spark, sf_dir):
    """Stored hashes against the bytes that are there."""
    return _integrity(spark, sf_dir)


@query(f"WITH {STORED} SELECT source, count(*) AS n_bad FROM st WHERE state <> 'AVAILABLE' GROUP BY ALL")
def integrity_refused(spark, sf_dir):
    """Sources that must not be analysed before their blobs are repaired."""
    return store.refused(table(spark, sf_dir, "documents").select("source", "doc_id"), _integrity(spark, sf_dir), "source", "doc_id")


@query("""
WITH r AS (SELECT o_orderkey AS result, o_orderpriority AS processor, CASE o_orderstatus WHEN 'F' THEN 'CURRENT' WHEN 'O' THEN 'STALE' ELSE 'FAILED' END AS state, o_orderdate AS created, o_orderkey % 2 = 0 AS direct, o_custkey AS artifact FROM orders),
b AS (SELECT processor, artifact, result, state, created, 0 AS hops FROM r WHERE direct
  UNION ALL SELECT x.processor, y.artifact, x.result, x.state, x.created, 1 FROM r x JOIN r y ON y.result = x.result - 1 WHERE NOT x.direct)
SELECT processor, artifact, result, state, CAST(hops AS INT) AS hops FROM b WHERE state <> 'FAILED' QUALIFY row_number() OVER (PARTITION BY processor, artifact ORDER BY hops, state = 'CURRENT' DESC, created DESC, result DESC) = 1
""")
def derived_for_artifact(spark, sf_dir):
    """The result of each processor that counts for an artifact, directly or by one hop of provenance."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "CURRENT").when(F.col("o_orderstatus") == "O", "STALE").otherwise("FAILED")
    results = o.select(F.col("o_orderkey").alias("result"), F.col("o_orderpriority").alias("processor"), state.alias("state"), F.col("o_orderdate").alias("created"))
    direct = F.col("o_orderkey") % 2 == 0
    inputs = o.select(F.col("o_orderkey").alias("result"), F.when(direct, "artifact").otherwise("derived").alias("kind"), F.when(direct, F.col("o_custkey")).otherwise(F.col("o_orderkey") - 1).alias("ref"))
    return store.derived_for(results, inputs)


@query("""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS ref FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part),
n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT ref, coalesce(p.p_partkey, n.k) AS p_partkey FROM r LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = ref LEFT JOIN n ON n.p_name = ref
""")
def product_lookup(spark, sf_dir):
    """References that may be ids, names or neither; a name that several have finds none."""
    part = table(spark, sf_dir, "part")
    refs = part.select(F.col("p_partkey").cast("string").alias("ref")).union(part.select("p_name")).union(part.select("p_brand")).distinct()
    return store.found_by(part, refs, "p_partkey", "p_name")


@query("""WITH d(key, default_) AS (VALUES ('13', 'a'), ('12', 'b'), ('-1', 'c')),
 w AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY ALL)
 SELECT d.key, coalesce(value, default_) AS value, value IS NOT NULL AS changed FROM d LEFT JOIN w USING (key)""")
def settings_view(spark, sf_dir):
    """Known settings with their last written value or their default."""
    stored = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return store.settings(stored, spark.createDataFrame([("13", "a"), ("12", "b"), ("-1", "c")], "key string, default string"))


@query("""WITH w AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS r FROM events)
 SELECT event_id, r >= coalesce(max(r) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM w""")
def settings_accepted(spark, sf_dir):
    """Writes that no earlier write of a higher mode forbids."""
    writes = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("mode"))
    return store.accepted_settings(writes, {"view": 0, "click": 1, "purchase": 2}).select("event_id", "accepted")


@query("SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'AVAILABLE' ELSE 'METADATA_ONLY' END AS integrity_state FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def pack_merge(spark, sf_dir):
    """Rows of a pack that the store lacks, with or without their bytes."""
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return store.merged_tables(known, table(spark, sf_dir, "part"), ["p_partkey"], F.col("p_retailprice") < 950).select("p_partkey", "integrity_state")


@query("""WITH u AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 45)
 SELECT l_suppkey, u.l_partkey, CASE WHEN b.l_partkey IS NOT NULL THEN 'IN_USE' WHEN n = 1 THEN 'EXCLUSIVE' ELSE 'SHARED' END AS plan FROM u JOIN n USING (l_partkey) LEFT JOIN b USING (l_partkey)""")
def purge_in_use(spark, sf_dir):
    """Purge plans, with artifacts that a job is at work on kept."""
    lines = table(spark, sf_dir, "lineitem")
    working = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    busy = lines.where("l_quantity > 45").join(working, "l_orderkey", "left_semi")
    return store.purge(retention.purge_plan(lines, "l_suppkey", "l_partkey"), busy, "l_partkey").select("l_suppkey", "l_partkey", "plan")


SPECS = [
    Spec("consensus", "pair", ("features", "match"), ("heavy",)), Spec("match", "pair", ("features",)), Spec("heavy", "pair", ("export",), heavy=True, provider="matrix", determinism="D3"),
    Spec("diff", "pair", (), heavy=True, provider="decompiler"), Spec("features", needs=("extract",)), Spec("extract", formats=("ECONOMY", "STANDARD"), provider="decompiler"), Spec("hash"),
]
TARGETS = """
 a AS (SELECT CAST(p_partkey AS VARCHAR) AS "left", CAST(NULL AS VARCHAR) AS "right", p_type AS lf, CAST(NULL AS VARCHAR) AS rf FROM part),
 pr AS (SELECT DISTINCT CAST(x.l_partkey AS VARCHAR) AS "left", CAST(y.l_partkey AS VARCHAR) AS "right", p.p_type AS lf, q.p_type AS rf FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN part p ON p.p_partkey = x.l_partkey JOIN part q ON q.p_partkey = y.l_partkey)"""
NODES = f"""{TARGETS},
 nodes AS (SELECT 'hash' AS processor, "left", "right", CAST(NULL AS VARCHAR) AS skip FROM a UNION ALL SELECT 'extract', "left", "right", CASE WHEN lf NOT IN ('ECONOMY', 'STANDARD') THEN 'SKIPPED_INCOMPATIBLE' END FROM a UNION ALL SELECT 'features', "left", "right", NULL FROM a
  UNION ALL SELECT 'match', "left", "right", NULL FROM pr UNION ALL SELECT 'consensus', "left", "right", NULL FROM pr UNION ALL SELECT 'heavy', "left", "right", 'SKIPPED_UNSUPPORTED' FROM pr UNION ALL SELECT 'diff', "left", "right", CASE WHEN "left" = "right" THEN 'SKIPPED_POLICY' END FROM pr)"""


def _plan(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("left"), F.col("p_type").alias("left_format"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("k"))
    pairs = lines.join(lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("k").alias("right")), ["l_orderkey", "l_linenumber"]).select(F.col("k").alias("left"), "right").distinct()
    pairs = pairs.join(part, "left").join(part.select(F.col("left").alias("right"), F.col("left_format").alias("right_format")), "right")
    none = F.lit(None).cast("string")
    targets = part.select("left", none.alias("right"), "left_format", none.alias("right_format")).unionByName(pairs.select("left", "right", "left_format", "right_format"))
    return planning.plan(SPECS, targets, {"decompiler"})


@query(f'WITH {NODES} SELECT processor, "left", "right", skip FROM nodes')
def plan_nodes(spark, sf_dir):
    """The plan of a comparison: a node for each processor and target, skipped ones with their reason."""
    return _plan(spark, sf_dir).select("processor", "left", "right", "skip")


@query(f"""WITH {NODES}, sound AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_size >= 10 AND p_type IN ('ECONOMY', 'STANDARD')),
 r AS (SELECT n.*, x.k IS NOT NULL AS l_ok, y.k IS NOT NULL AS r_ok FROM nodes n LEFT JOIN sound x ON x.k = "left" LEFT JOIN sound y ON y.k = "right")
 SELECT processor, "left", "right", coalesce(skip, CASE WHEN processor = 'features' AND NOT l_ok THEN 'SKIPPED_UNSUPPORTED' WHEN processor IN ('match', 'consensus') AND NOT (l_ok AND r_ok) THEN 'SKIPPED_UNSUPPORTED' END) AS skip,
  CASE WHEN skip IS NOT NULL THEN CASE skip WHEN 'SKIPPED_INCOMPATIBLE' THEN 'input format not supported' WHEN 'SKIPPED_UNSUPPORTED' THEN 'provider unavailable' ELSE 'identical bytes on both sides' END
   WHEN processor = 'features' AND NOT l_ok THEN 'dependency extract unavailable' WHEN processor IN ('match', 'consensus') AND NOT (l_ok AND r_ok) THEN 'dependency features unavailable' END AS reason FROM r""")
def plan_resolved(spark, sf_dir):
    """Nodes that cannot run because something that they need, on either side, has no result."""
    nodes = _plan(spark, sf_dir)
    sound = table(spark, sf_dir, "part").where("p_size >= 10 AND p_type IN ('ECONOMY', 'STANDARD')").select(F.col("p_partkey").cast("string").alias("left"))
    results = nodes.where("skip IS NULL AND processor IN ('extract', 'features')").join(sound, "left", "left_semi").select("processor", "left", "right")
    results = results.unionByName(nodes.where("processor = 'match'").select("processor", "left", "right"))
    edges = planning.dependencies(nodes, {s.id: s.scope for s in SPECS})
    return planning.resolved(nodes, edges, results).select("processor", "left", "right", "skip", "reason")


CACHE = """
 c AS (SELECT c_custkey || '-1-URGENT' AS cache_key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'STALE' ELSE 'CURRENT' END AS state, c_acctbal > 4000 AS sound FROM customer),
 n AS (SELECT o_orderkey AS node, o_custkey || '-' || o_orderpriority AS cache_key, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders)"""


@query(f"""WITH {CACHE} SELECT node, n.cache_key, CASE WHEN sound THEN 'HIT' WHEN k > 1 THEN 'WAIT' WHEN sound IS NOT NULL THEN 'CORRUPTED' ELSE 'MISS' END AS lookup FROM n LEFT JOIN (SELECT * FROM c WHERE state = 'CURRENT') c USING (cache_key)""")
def cache_lookup(spark, sf_dir):
    """Nodes whose result is there; of nodes with one key the first computes it and the others wait."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("cache_key"))
    sound = F.col("c_acctbal") > 4000
    cache = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("-1-URGENT")).alias("cache_key"), F.when(F.col("c_mktsegment") == "BUILDING", "STALE").otherwise("CURRENT").alias("state"), F.lit("a").alias("sha256"), F.when(sound, "a").when(F.col("c_acctbal") > 2000, "b").alias("digest"))
    return planning.cache_state(nodes, cache)


@query("""SELECT o_orderkey AS node, sha256('["match","1.0",["' || sha256(CAST(o_custkey AS VARCHAR)) || '","' || sha256(o_orderpriority) || '"],"' || sha256(o_orderstatus) || '",2]') AS cache_key FROM orders""")
def cache_keys(spark, sf_dir):
    """Keys of results: what they depend on, as a canonical array."""
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    key = canonical.cache_key(F.lit("match"), F.lit("1.0"), F.array(sha("o_custkey"), sha("o_orderpriority")), sha("o_orderstatus"), F.lit(2))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), key.alias("cache_key"))


RUN_NODES = """
 n AS (SELECT l_orderkey AS run, 'p' || l_linenumber AS processor, CASE WHEN l_linestatus = 'O' AND l_linenumber < 3 THEN CASE WHEN l_linenumber = 1 THEN 'SKIPPED_POLICY' ELSE 'SKIPPED_UNSUPPORTED' END END AS skip, CASE l_returnflag WHEN 'R' THEN 'SUCCESS' WHEN 'N' THEN 'PERMANENT_FAILURE' ELSE 'PARTIAL' END AS o FROM lineitem),
 m AS (SELECT run, processor, skip, coalesce(skip, o) AS outcome FROM n)"""


def _run_nodes(spark, sf_dir) -> DataFrame:
    skip = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") < 3), F.when(F.col("l_linenumber") == 1, "SKIPPED_POLICY").otherwise("SKIPPED_UNSUPPORTED"))
    outcome = F.when(F.col("l_returnflag") == "R", "SUCCESS").when(F.col("l_returnflag") == "N", "PERMANENT_FAILURE").otherwise("PARTIAL")
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("p"), "l_linenumber").alias("processor"), skip.alias("skip"), outcome.alias("outcome"))
    return own.withColumn("outcome", F.coalesce("skip", "outcome"))


@query(f"""WITH {RUN_NODES}, s AS (SELECT run, count(*) FILTER (WHERE a) AS applicable, count(*) FILTER (WHERE a AND outcome = 'SUCCESS') AS ok, count(*) FILTER (WHERE a AND outcome <> 'SUCCESS') AS missing, count(*) FILTER (WHERE a AND outcome IN ('SUCCESS', 'PARTIAL')) AS produced,
   coalesce(array_to_string(list_sort(list(DISTINCT processor) FILTER (WHERE a AND outcome <> 'SUCCESS')), ','), '') AS missing_processors FROM (SELECT *, coalesce(skip, '') <> 'SKIPPED_POLICY' AS a FROM m) GROUP BY ALL)
 SELECT run, applicable, ok, missing, missing_processors, CASE WHEN applicable > 0 AND produced = 0 THEN 'FAILED' WHEN missing > 0 THEN 'COMPLETED_PARTIAL' ELSE 'COMPLETED' END AS status, CAST(ok * 1000000 // nullif(applicable, 0) AS BIGINT) AS coverage_ppm FROM s""")
def run_state(spark, sf_dir):
    """Coverage, missing evidence and status of each run."""
    out = planning.run_state(_run_nodes(spark, sf_dir), "run")
    return out.select("run", "applicable", "ok", "missing", F.array_join("missing_processors", ",").alias("missing_processors"), "status", F.floor(F.col("coverage") * 1000000 + 0.0001).cast("long").alias("coverage_ppm"))


@query(f"WITH {RUN_NODES} SELECT run, processor, outcome, count(*) AS n FROM m GROUP BY ALL")
def outcome_matrix(spark, sf_dir):
    return planning.outcome_matrix(_run_nodes(spark, sf_dir), "run")


@query(f"WITH {RUN_NODES} SELECT DISTINCT run, processor FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.run = a.run AND b.processor = a.processor AND b.outcome IN ('SUCCESS', 'PARTIAL', 'SKIPPED_POLICY'))")
def resumed_nodes(spark, sf_dir):
    """What a resumed run has still to do; settled nodes are not redone."""
    nodes = _run_nodes(spark, sf_dir)
    return planning.to_do(nodes.select("run", "processor").distinct(), nodes.where(F.col("outcome").isin("SUCCESS", "PARTIAL", "SKIPPED_POLICY")), ["run", "processor"])


RULES = [("oom", r"purchase .*[05]$", "INVALID"), ("late", r"^error", "PARTIAL"), ("note", r"click 1", "COMPLETE")]


@query("""WITH e AS (SELECT event_id, event_type, value, user_id, event_type || ' ' || CAST(CAST(floor(value) AS INT) AS VARCHAR) AS text FROM events),
 r AS (SELECT *, list_filter([CASE WHEN event_type = 'view' AND value > 60 THEN 2 WHEN value > 90 THEN 2 END, CASE WHEN user_id % 5 = 1 THEN 2 END, CASE WHEN user_id % 7 = 2 THEN 3 END, CASE WHEN user_id % 7 = 3 THEN 2 END, CASE WHEN value < 5 THEN 3 END,
   CASE WHEN regexp_matches(text, 'purchase .*[05]$') THEN 3 END, CASE WHEN regexp_matches(text, '^error') THEN 2 END], lambda x: x IS NOT NULL) AS found FROM e),
 s AS (SELECT *, CASE WHEN event_type = 'signup' AND value > 50 THEN 3 ELSE coalesce(list_max(found), 1) END AS rank FROM r)
 SELECT event_id, ['COMPLETE', 'PARTIAL', 'INVALID'][rank] AS completion, CASE WHEN event_type = 'signup' AND value > 50 THEN 'CANCELLED' WHEN user_id = 13 THEN 'RETRYABLE_FAILURE' WHEN rank = 1 THEN 'SUCCESS' WHEN rank = 2 THEN 'PARTIAL' WHEN event_type = 'view' AND value > 60 THEN 'RETRYABLE_FAILURE' ELSE 'PERMANENT_FAILURE' END AS outcome FROM s""")
def completion_verdict(spark, sf_dir):
    """Worker runs judged by the worst of exit, manifest, checksums and log rules."""
    v, u = F.col("value"), F.col("user_id")
    runs = table(spark, sf_dir, "events").withColumn("text", F.concat_ws(" ", "event_type", F.floor(v).cast("int").cast("string")))
    declared = F.when(u % 7 == 2, F.lit(None).cast("string")).when(u % 7 == 3, "PARTIAL").otherwise("COMPLETE")
    runs = runs.select(
        "event_id", F.when((F.col("event_type") == "view") & (v > 60), "CRASH").otherwise("NORMAL").alias("termination"), F.when(v > 90, 1).otherwise(0).alias("exit_code"), ((F.col("event_type") == "signup") & (v > 50)).alias("cancelled"),
        (u == 13).alias("hung"), declared.alias("declared"), F.when(u % 5 == 1, 1).otherwise(0).alias("engine_errors"), F.lit(2).alias("n_expected"), F.when(v < 5, 1).otherwise(2).alias("n_sound"),
        F.transform(planning.log_matches(runs, RULES), lambda m: m["effect"]).alias("log_effects"),
    )
    return planning.verdict(runs).select("event_id", "completion", "outcome")


@query("""SELECT p_partkey, p_size % 3 <> 0 AS bit_identical, CASE WHEN p_size % 2 = 0 THEN p_size % 3 <> 0 ELSE p_size % 5 <> 0 END AS match FROM part""")
def determinism_check(spark, sf_dir):
    """Repeated results: a D0 processor must give the same bytes, others the same content."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "D0").otherwise("D1")
    first = part.select("p_partkey", kind.alias("class"), F.lit("a").alias("sha256"), F.lit("c").alias("canonical"))
    second = part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "b").otherwise("a").alias("sha256"), F.when(F.col("p_size") % 5 == 0, "d").otherwise("c").alias("canonical"))
    return planning.determinism(first, second, "p_partkey").select("p_partkey", "bit_identical", "match")


STATES = ["QUEUED", "PREPARING", "RUNNING", "POST_PROCESSING", "COMPLETED"]


def _job_state() -> F.Column:
    return F.get(F.array(*(F.lit(s) for s in STATES)), (F.col("event_id") % 5).cast("int"))


@query("""WITH s AS (SELECT event_id, user_id, ['QUEUED', 'PREPARING', 'RUNNING', 'POST_PROCESSING', 'COMPLETED'][1 + event_id % 5] AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
 SELECT event_id, state, before, CASE WHEN before IS NULL THEN state = 'QUEUED' ELSE (before || '>' || state) IN ('QUEUED>PREPARING', 'PREPARING>RUNNING', 'RUNNING>POST_PROCESSING', 'POST_PROCESSING>COMPLETED') END AS allowed FROM b""")
def job_steps(spark, sf_dir):
    """State rows of jobs, with the steps that no job may take."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", _job_state().alias("state"))
    return planning.job_steps(own, "user_id", "event_id").select("event_id", "state", "before", "allowed")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN NULL WHEN event_type = 'view' THEN 'CANCELLED' WHEN event_type = 'click' THEN 'FAILED_RETRYABLE' WHEN event_id % 5 IN (1, 2, 3) THEN 'INTERRUPTED' END AS next FROM events""")
def job_recovery(spark, sf_dir):
    """What becomes of jobs whose owner died."""
    state = F.when(F.col("event_type") == "view", "CANCELLING").when(F.col("event_type") == "click", "HUNG").otherwise(_job_state())
    return planning.recovered(table(spark, sf_dir, "events").withColumn("state", state), F.col("user_id") % 2 == 0).select("event_id", "next")


@query("""SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN CASE WHEN value > 80 THEN 2 ELSE 1 END WHEN 'signup' THEN CASE WHEN value > 120 THEN 1 ELSE 0 END ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'OK' END AS health FROM events GROUP BY ALL""")
def system_health(spark, sf_dir):
    """The worst check of each system."""
    e, v = F.col("event_type"), F.col("value")
    state = F.when(e == "error", F.when(v > 80, "FAIL").otherwise("WARN")).when((e == "signup") & (v > 120), "NOT_AVAILABLE").otherwise("OK")
    return planning.health(table(spark, sf_dir, "events").select("user_id", state.alias("state")), "user_id")


@query("""WITH n AS (SELECT o_orderkey, nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) * 900 AS a, count(*) FILTER (WHERE l_returnflag = 'R') * 1100 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
 SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) > 4000 THEN 'FUNCTION_COUNT' WHEN a > 0 AND b > 0 AND a * b * 64 > 200000000 THEN 'MEMORY' END AS refused FROM n""")
def heavy_matcher_gate(spark, sf_dir):
    """Pairs that a heavy matcher is not started on; unknown sizes refuse nothing."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    own = lines.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return own.select("o_orderkey", planning.heavy_gate(F.nullif("a", F.lit(0)) * 900, F.col("b") * 1100, 4000, 64, 200_000_000).alias("refused"))


@query("""WITH v AS (SELECT p_partkey, [CAST(p_size AS INT) // 10, CAST(p_size AS INT) % 10] AS v FROM part) SELECT p_partkey, v >= [1, 2] AND v < [3] AS limited, v == [2, 4] AS exact FROM v""")
def known_limitations(spark, sf_dir):
    """Versions to which a limitation applies."""
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", canonical.version_in_range(version, ">=1.2, <3").alias("limited"), canonical.version_in_range(version, "==2.4").alias("exact"))


@query(r"""SELECT page_id, CASE WHEN trim(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), ' .') = '' THEN '_' ELSE trim(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), ' .') END AS name,
 CASE WHEN length(url) > 40 THEN url[1:40] || '…' ELSE url END AS short FROM pages""")
def safe_names(spark, sf_dir):
    """Names for files, and short ones for lists."""
    return table(spark, sf_dir, "pages").select("page_id", canonical.safe_name(F.coalesce("url", F.lit(""))).alias("name"), canonical.shortened(F.col("url"), 40).alias("short"))


@query("""SELECT event_id, ts + INTERVAL 9 HOUR AS shown, CASE WHEN event_type <> 'error' THEN value END AS measured, json_extract_string(props, '$.k') AS k FROM events""")
def shown_values(spark, sf_dir):
    """Local time, values only where measured, and a path of a document."""
    family = F.struct(F.when(F.col("event_type") == "error", "PARTIAL").otherwise("MEASURED").alias("state"), F.col("value").alias("value"))
    return table(spark, sf_dir, "events").select("event_id", canonical.local_time(F.col("ts"), "Asia/Tokyo").alias("shown"), canonical.measured(family).alias("measured"), canonical.dotted(F.col("props"), "k").alias("k"))


MIXED = "x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS v FROM part)"


@query(f"""WITH {MIXED} SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY v IS NOT NULL, CASE WHEN v IS NULL THEN 0 WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END, coalesce(TRY_CAST(v AS DOUBLE), 0), lower(coalesce(v, '')), p_partkey) AS INT) AS place FROM x""")
def mixed_order(spark, sf_dir):
    """The place of values of any kind: nothing, numbers, text."""
    from pyspark.sql import Window

    s = F.col("p_size") % 4
    value = F.when(s == 1, F.col("p_size").cast("string")).when(s == 2, F.col("p_name")).when(s == 3, F.col("p_retailprice").cast("string"))
    own = table(spark, sf_dir, "part").select("p_partkey", canonical.mixed_order(value).alias("o"))
    return own.select("p_partkey", F.row_number().over(Window.partitionBy(F.col("p_partkey") % 20).orderBy("o", "p_partkey")).alias("place"))


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(chr(31), p_name, p_brand, p_type)), 'small') AND p_type = 'ECONOMY'")
def table_filter(spark, sf_dir):
    """Rows that show a text in any column and have a value in one."""
    return table(spark, sf_dir, "part").where(canonical.row_matches(["p_name", "p_brand", "p_type"], "SMALL", p_type="ECONOMY")).select("p_partkey")


@query("""WITH x AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')
 SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT k FROM x UNION SELECT s FROM x) AND p_partkey NOT IN (SELECT k FROM y WHERE k % 2 = 0)""")
def either_side(spark, sf_dir):
    """Names of what stands on either side of a run's rows."""
    lines = table(spark, sf_dir, "lineitem")
    sides = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p_partkey")).union(lines.where(F.col("l_returnflag") == flag).select("l_suppkey")).distinct()
    return table(spark, sf_dir, "part").join(sides("A"), "p_partkey", "left_semi").join(sides("R").where("p_partkey % 2 = 0"), "p_partkey", "left_anti").select("p_partkey", "p_name")
