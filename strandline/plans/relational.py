"""Read models, joins, windows and set operations over the driver's tables.

Adapters: product = customer, version = order, component = line item, artifact = part, event = event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, retention, search, versions
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


ORDER = ("o_orderdate", "o_orderkey")


@query("""
WITH m AS (
  SELECT o_custkey, o_orderkey, o_orderdate, abs((o_totalprice - lag(o_totalprice) OVER w) / nullif(lag(o_totalprice) OVER w, 0.0)) AS metric
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
h AS (SELECT *, coalesce(list(metric) FILTER (WHERE metric IS NOT NULL) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS hist FROM m),
d AS (SELECT *, list_aggregate(hist, 'median') AS md FROM h),
e AS (SELECT *, list_aggregate(list_transform(hist, lambda x: abs(x - md)), 'median') AS mad FROM d)
SELECT o_custkey AS product, o_orderkey AS version, len(hist)::INT AS n_history,
  CASE WHEN metric IS NULL OR len(hist) < 5 THEN 'UNKNOWN'
       WHEN mad = 0 THEN CASE WHEN metric = md THEN 'NORMAL' ELSE 'EXTREME' END
       WHEN abs(metric - md) * 0.6745 / mad >= 7.0 THEN 'EXTREME' WHEN abs(metric - md) * 0.6745 / mad >= 3.5 THEN 'UNUSUAL' ELSE 'NORMAL' END AS class
FROM e
""")
def flagship_baseline_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version's size change against the robust history of its product."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    measured = versions.change_ratio(orders, "o_custkey", "o_totalprice", *ORDER)
    out = versions.with_baseline(measured, "o_custkey", *ORDER)
    return out.select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("version"), "n_history", "class")


@query("""
SELECT o_custkey AS product, count(*) AS n_values, CAST(floor(quantile_cont(o_totalprice, 0.05) + 0.0001) AS BIGINT) AS p05,
  CAST(floor(quantile_cont(o_totalprice, 0.5) + 0.0001) AS BIGINT) AS p50, CAST(floor(quantile_cont(o_totalprice, 0.95) + 0.0001) AS BIGINT) AS p95
FROM orders GROUP BY o_custkey HAVING count(*) >= 2
""")
def baseline_percentiles(spark, sf_dir):
    p = F.percentile("o_totalprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("product")).agg(F.count(F.lit(1)).alias("n_values"), p.alias("p")).where("n_values >= 2")
    return out.select("product", "n_values", *(F.floor(F.get("p", F.lit(k)) + 0.0001).cast("long").alias(n) for k, n in enumerate(("p05", "p50", "p95"))))


@query("SELECT o_custkey AS product, o_orderkey AS version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS ord FROM orders")
def ordered_versions(spark, sf_dir):
    out = versions.ordered(table(spark, sf_dir, "orders"), "o_custkey", *ORDER)
    return out.select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("version"), "ord")


TRANSITIONS = """
  SELECT * FROM (SELECT o_custkey AS product, o_orderkey AS "left", lead(o_orderkey) OVER w AS "right", CAST(row_number() OVER w AS INT) AS step
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE "right" IS NOT NULL"""


def _transitions(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), "o_orderkey", "o_orderdate")
    return versions.transitions(orders, "product", "o_orderkey", *ORDER)


@query(TRANSITIONS)
def adjacent_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir)


@query("""
SELECT product, version, gap_days FROM (
  SELECT o_custkey AS product, o_orderkey AS version, CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS gap_days
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE gap_days IS NOT NULL
""")
def first_observed_gap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(*ORDER)
    gap = F.datediff("o_orderdate", F.lag("o_orderdate").over(w))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("version"), gap.alias("gap_days")).where("gap_days IS NOT NULL")


@query("SELECT user_id AS scope, event_type AS kind, arg_max(event_id, (ts, event_id)) AS event FROM events GROUP BY ALL")
def latest_per_scope(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("kind"), F.col("event_id").alias("event"), "ts")
    return versions.latest(own, ["scope", "kind"], F.desc("ts"), F.desc("event")).drop("ts")


@query("""
SELECT o_orderkey AS version, coalesce(c_name, 'UNKNOWN') AS product_name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def version_left_release(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    out = table(spark, sf_dir, "orders").join(dim, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select(F.col("o_orderkey").alias("version"), F.coalesce("c_name", F.lit("UNKNOWN")).alias("product_name"), F.col("c_mktsegment").alias("segment"))


@query("""
SELECT o_orderkey AS version, l_returnflag || l_linestatus AS role, p_partkey AS artifact, p_type AS format, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def component_artifact_3way(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = F.col("o_orderkey").alias("version"), F.concat("l_returnflag", "l_linestatus").alias("role"), F.col("p_partkey").alias("artifact"), F.col("p_type").alias("format")
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query(f"""
WITH t AS ({TRANSITIONS}), i AS (SELECT l_orderkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
a AS (SELECT "left", "right", l_partkey AS k, q AS a FROM t JOIN i ON "left" = l_orderkey), b AS (SELECT "left", "right", l_partkey AS k, q AS b FROM t JOIN i ON "right" = l_orderkey)
SELECT "left", "right", count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE b IS NULL) AS removed, count(*) FILTER (WHERE a <> b) AS changed,
  count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS symmetric_difference
FROM a FULL JOIN b USING ("left", "right", k) GROUP BY ALL
""")
def component_set_diff(spark, sf_dir):
    return joins.set_difference(_transitions(spark, sf_dir), _items(spark, sf_dir), "l_orderkey", "l_partkey", "q")


@query(f"""
WITH t AS ({TRANSITIONS}),
c AS (SELECT l_orderkey, l_returnflag || l_linestatus AS role, lower(l_shipdate::DATE::VARCHAR[1:7]) AS label, l_partkey AS artifact FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS l_shipdate, l_partkey FROM lineitem)),
a AS (SELECT "left", "right", role, label, artifact AS a, row_number() OVER (PARTITION BY "left", "right", role, label ORDER BY artifact) AS n FROM t JOIN c ON "left" = l_orderkey),
b AS (SELECT "left", "right", role, label, artifact AS b, row_number() OVER (PARTITION BY "left", "right", role, label ORDER BY artifact) AS n FROM t JOIN c ON "right" = l_orderkey),
named AS (SELECT "left", "right", role, a, b, 'LABEL' AS rule FROM a JOIN b USING ("left", "right", role, label, n)),
ra AS (SELECT "left", "right", role, a, row_number() OVER (PARTITION BY "left", "right", role ORDER BY label, a) AS n FROM a ANTI JOIN b USING ("left", "right", role, label, n)),
rb AS (SELECT "left", "right", role, b, row_number() OVER (PARTITION BY "left", "right", role ORDER BY label, b) AS n FROM b ANTI JOIN a USING ("left", "right", role, label, n))
SELECT * FROM named UNION ALL SELECT "left", "right", role, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'POSITION' ELSE 'UNKNOWN' END FROM ra FULL JOIN rb USING ("left", "right", role, n)
""".replace("lower(l_shipdate::DATE::VARCHAR[1:7])", "l_shipdate"))
def component_pairing(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("role"), F.date_format("l_shipdate", "yyyy-MM").alias("label"), F.col("l_partkey").alias("artifact")
    )
    return joins.pair_components(_transitions(spark, sf_dir), own.distinct(), "l_orderkey", "role", "label", "artifact")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), n AS (SELECT g, count(*) AS n FROM s GROUP BY g),
p AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.g < y.g GROUP BY ALL)
SELECT a, b, shared, na.n AS na, nb.n AS nb FROM p JOIN n na ON a = na.g JOIN n nb ON b = nb.g WHERE shared >= (na.n + nb.n - shared) * 0.5
""")
def near_duplicate_jaccard(spark, sf_dir):
    return joins.near_duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 0.5)


@query("""
SELECT l_orderkey AS version, l_returnflag || l_linestatus AS role, l_linenumber AS purpose, l_partkey AS artifact,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS ordinal
FROM lineitem
""")
def duplicate_ordinals(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("role", F.concat("l_returnflag", "l_linestatus"))
    out = versions.duplicate_ordinals(own, ["l_orderkey", "role", "l_linenumber"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return out.select(F.col("l_orderkey").alias("version"), "role", F.col("l_linenumber").alias("purpose"), F.col("l_partkey").alias("artifact"), "ordinal")


@query(r"""
SELECT l_orderkey AS version, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS n_entries
FROM (SELECT l_orderkey, l_returnflag || l_linestatus || chr(9) || l_partkey || chr(9) || l_linenumber AS line FROM lineitem) GROUP BY ALL
""")
def version_fingerprint(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), F.concat("l_returnflag", "l_linestatus").alias("role"), "l_partkey", "l_linenumber")
    return versions.fingerprint(own, "version", ["role", "l_partkey", "l_linenumber"])


@query("""
SELECT l_orderkey AS version, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS roles_, 0 AS x FROM lineitem GROUP BY ALL
""".replace("list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS roles_, 0 AS x", """
  CASE WHEN count(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IN ('A', 'N', 'R')) = 3 THEN 'COMPLETE' WHEN count(DISTINCT l_returnflag) >= 2 THEN 'PARTIAL' ELSE 'UNASSESSED' END AS completeness,
  coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS present"""))
def role_completeness(spark, sf_dir):
    """Expected roles that are not seen are unknown, never absent."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("r"))
    missing = F.size(F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("r")))
    state = F.when(missing == 0, "COMPLETE").when(F.size("r") >= 2, "PARTIAL").otherwise("UNASSESSED")
    return own.select("version", state.alias("completeness"), F.array_join("r", ",").alias("present"))


@query("""
SELECT kind, ref, day, CAST(row_number() OVER (PARTITION BY who ORDER BY day IS NULL, day, kind, ref) AS INT) AS place, who FROM (
  SELECT 'version' AS kind, o_orderkey AS ref, CAST(o_orderdate AS DATE) AS day, o_custkey % 150 AS who FROM orders
  UNION ALL SELECT 'event', event_id, CAST(ts AS DATE), user_id FROM events WHERE event_type <> 'view')
""")
def timeline_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("version").alias("kind"), F.col("o_orderkey").alias("ref"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 150).alias("who"))
    b = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.lit("event").alias("kind"), F.col("event_id").alias("ref"), F.to_date("ts").alias("day"), F.col("user_id").alias("who"))
    w = Window.partitionBy("who").orderBy(F.col("day").isNull(), "day", "kind", "ref")
    return a.unionByName(b).withColumn("place", F.row_number().over(w))


@query("""
WITH p AS (SELECT user_id, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events WHERE event_type = 'purchase')
SELECT p.user_id, lo, hi, arg_min(event_id, (ts, event_id)) AS event FROM (SELECT * FROM p WHERE hi IS NOT NULL) p
LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > lo AND e.ts <= hi GROUP BY ALL
""")
def event_interval_join(spark, sf_dir):
    """The first error between two purchases of a user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    windows = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("lo"), F.lead("ts").over(w).alias("hi")).where("hi IS NOT NULL").distinct()
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("event"))
    return joins.first_event_between(windows, errors, "user_id", 6 * 3600)


@query("""
WITH p AS (SELECT user_id, CAST(min(ts) AS DATE) AS lo, CAST(min(ts) AS DATE) + 2 AS hi FROM events WHERE event_type = 'purchase' GROUP BY ALL),
e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
SELECT user_id, lo, hi, event_id, 'TEMPORAL_CORRELATION' AS relation, 'LOW' AS strength FROM p JOIN e USING (user_id) WHERE lo - day <= 7 AND day - hi <= 7
""")
def event_window_correlation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = F.to_date(F.min("ts"))
    windows = events.where("event_type = 'purchase'").groupBy("user_id").agg(first.alias("lo"), F.date_add(first, 2).alias("hi"))
    errors = events.where("event_type = 'error'").select("user_id", "event_id", F.to_date("ts").alias("day"))
    near = joins.events_near(windows, errors, "user_id", 7)
    low = scalar.evidence_strength(F.lit("COMMUNITY"), F.lit(None).cast("string"), F.lit(False))
    return near.select("user_id", "lo", "hi", "event_id", "relation", low.alias("strength"))


@query("""
WITH hits AS (
  SELECT 'page' AS kind, page_id AS id, url AS label, 0 AS rank FROM pages WHERE contains(lower(url), 'the')
  UNION ALL SELECT 'part', p_partkey, p_name, 1 FROM part WHERE contains(lower(p_name), 'the') UNION ALL SELECT 'product', c_custkey, c_name, 2 FROM customer WHERE contains(lower(c_name), '00')),
one AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY rank, label) AS n FROM hits)
SELECT kind, id, label, CAST(rank AS INT) AS rank FROM one WHERE n = 1 ORDER BY rank, kind, id LIMIT 50
""")
def global_search(spark, sf_dir):
    def part(name, kind, key, label, needle):
        return table(spark, sf_dir, name).where(search.contains_text(F.col(label), needle)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"))

    return search.merged([part("pages", "page", "page_id", "url", "THE"), part("part", "part", "p_partkey", "p_name", "The"), part("customer", "product", "c_custkey", "c_name", "00")], 50)


@query(r"""
SELECT doc_id, source FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'for')
""")
def token_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(search.has_tokens(F.col("text"), "The FOR")).select("doc_id", "source")


@query(r"""
SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'data') AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'the')
""")
def indexed_search(spark, sf_dir):
    """A conjunction of words through the token table of all texts, which is written once and read by word."""
    docs = table(spark, sf_dir, "documents")
    return search.find(search.stored_index(docs, "doc_id", "text"), "doc_id", "the data")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) >= 'a' AND sha256(text) < 'ag'")
def hash_prefix_range(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return own.where(search.hash_prefix(F.col("sha"), "a"))


@query("""
SELECT c_custkey AS product, count(o_orderkey) AS n_versions, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
""")
def dashboard_counts(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select(F.col("c_custkey").alias("product"), F.coalesce("n", F.lit(0)).cast("long").alias("n_versions"), "first_seen", "last_seen")


@query("SELECT o_orderkey AS version, o_custkey AS product, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_topk(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("product"), F.col("o_orderdate").alias("at"))
    return own.orderBy(F.desc("at"), F.desc("version")).limit(20)


@query("""
SELECT event_id, user_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER w > 500000 AS expired, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS running
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)
""")
def retention_cumulative_budget(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("size", F.floor(F.col("value") * 100).cast("long"))
    return retention.over_budget(own, "user_id", "ts", "size", 500000, "event_id").select("event_id", "user_id", "expired", "running")


@query("""
WITH r AS (SELECT event_id, user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n,
  row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS w, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('week', ts) DESC) AS k FROM events)
SELECT event_id, user_id, week, n <= 7 OR (w = 1 AND k <= 4) AS kept FROM r
""")
def retention_weekly(spark, sf_dir):
    return retention.backups_to_keep(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "week", "kept")


@query("""
WITH u AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS artifact FROM lineitem)
SELECT owner, artifact, count(*) OVER (PARTITION BY artifact) AS n_owners, CASE WHEN count(*) OVER (PARTITION BY artifact) = 1 THEN 'EXCLUSIVE' ELSE 'SHARED' END AS plan FROM u
""")
def purge_plan(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("artifact"))
    return retention.purge_plan(own, "owner", "artifact").select("owner", "artifact", "n_owners", "plan")


@query("""
SELECT coalesce(p_partkey, l_partkey) AS artifact, CASE WHEN p_partkey IS NULL THEN 'MISSING' WHEN l_partkey IS NULL THEN 'ORPHAN' ELSE 'OK' END AS state
FROM (SELECT p_partkey FROM part WHERE p_size > 5) FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey
""")
def reconcile_antijoins(spark, sf_dir):
    stored = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("artifact"))
    return retention.reconciled(stored, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("artifact")), "artifact")


@query("""
WITH e AS (SELECT event_type AS queue, event_id, length(event_type) + CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60) AS BIGINT) AS effective FROM events)
SELECT queue, event_id, effective FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY effective DESC, event_id) AS n FROM e) WHERE n = 1
""")
def job_pick_aging(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), "event_id", "ts", F.length("event_type").alias("priority"))
    return retention.next_jobs(jobs, "queue", "priority", "ts", "event_id", F.lit("2024-02-01 00:00:00").cast("timestamp")).select("queue", "event_id", "effective")


@query("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, min(ts) AS first_ts FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s
""")
def session_windows(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"))
    return out.select("user_id", "n_events", "first_ts")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "cents")


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '<mail>', 'g'),
  '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '<address>', 'g'), '[0-9a-f]{32,}', '<hex>', 'g'), '[0-9]{9,}', '<number>', 'g') AS clean FROM documents
""")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.sanitized(F.col("text")).alias("clean"))


@query(r"""
WITH s AS (SELECT page_id, list_distinct(regexp_extract_all(html, '[ -~]{5,256}')) AS v, len(regexp_extract_all(html, '[ -~]{5,256}')) AS n FROM pages)
SELECT page_id, CAST(n AS INT) AS n, CAST(len(v) AS INT) AS n_unique, sha256(array_to_string(list_sort(v), chr(10))) AS set_sha FROM s
""")
def strings_extract(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("[ -~]{5,256}"), F.lit(0)).alias("s"))
    unique = F.array_distinct("s")
    return own.select("page_id", F.size("s").alias("n"), F.size(unique).alias("n_unique"), F.sha2(F.array_join(F.array_sort(unique), "\n"), 256).alias("set_sha"))
