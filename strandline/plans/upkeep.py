"""Upkeep, watching and provenance over the driver's tables.

Adapters: event = file or job, order = run, line item = input of a run, part = artifact, document = annotation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import retention, search, store, versions
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


KEPT = """
 f AS (SELECT event_id, user_id AS root, CASE event_type WHEN 'view' THEN 'temp' WHEN 'click' THEN 'logs' WHEN 'signup' THEN 'backups' WHEN 'error' THEN 'quarantine' ELSE 'cache' END AS category, 'n' || event_id || CASE WHEN event_id % 9 = 0 THEN '.tmp' ELSE '' END AS name, ts AS made, CAST(floor(value) AS BIGINT) AS bytes, CASE WHEN event_id % 4 = 0 THEN 'FAILED' WHEN event_id % 4 = 1 THEN 'CORRUPTED' ELSE 'CURRENT' END AS state FROM events),
 g AS (SELECT *, date_diff('second', made, TIMESTAMP '2024-02-01') / 86400.0 AS age, sum(bytes) OVER (PARTITION BY root, category ORDER BY made DESC, name ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY root, category ORDER BY made DESC, name DESC) AS n, row_number() OVER (PARTITION BY root, category, date_trunc('week', made) ORDER BY made DESC, name DESC) AS w, dense_rank() OVER (PARTITION BY root, category ORDER BY date_trunc('week', made) DESC) AS k FROM f),
 p AS (SELECT *, CASE category WHEN 'temp' THEN CASE WHEN event_id % 7 <> 3 AND (ends_with(name, '.tmp') OR age >= 10) THEN 'temporary' END WHEN 'logs' THEN CASE WHEN running > 1000 THEN 'beyond the log budget' END WHEN 'backups' THEN CASE WHEN NOT (n <= 7 OR (w = 1 AND k <= 4)) THEN 'outside the schedule' END
   WHEN 'quarantine' THEN CASE WHEN age >= 25 THEN 'old quarantine' END ELSE CASE WHEN state <> 'CURRENT' THEN 'failed result' END END AS reason FROM g)"""


def _cleanup(spark, sf_dir) -> DataFrame:
    e, i = F.col("event_type"), F.col("event_id")
    category = F.when(e == "view", "temp").when(e == "click", "logs").when(e == "signup", "backups").when(e == "error", "quarantine").otherwise("cache")
    name = F.concat(F.lit("n"), i.cast("string"), F.when(i % 9 == 0, ".tmp").otherwise(""))
    state = F.when(i % 4 == 0, "FAILED").when(i % 4 == 1, "CORRUPTED").otherwise("CURRENT")
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), category.alias("category"), name.alias("name"), F.col("ts").alias("at"), F.floor("value").cast("long").alias("bytes"), state.alias("state"), "event_id")
    return retention.cleanup_plan(own.drop("event_id"), own.where("event_id % 7 = 3").select("name"), F.lit("2024-02-01").cast("timestamp"), 10, 25, 1000)


@query(f"WITH {KEPT} SELECT root, category, name, bytes, reason FROM p WHERE reason IS NOT NULL")
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What upkeep may remove, and why."""
    return _cleanup(spark, sf_dir)


@query(f"WITH {KEPT} SELECT root, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM p WHERE reason IS NOT NULL GROUP BY ALL")
def cleanup_totals(spark, sf_dir):
    return _cleanup(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"))


@query("""SELECT DISTINCT l_partkey AS artifact, 'QUARANTINED' AS state FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def quarantine_orphans(spark, sf_dir):
    """Blobs that no row of the catalogue knows."""
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("artifact"))
    return retention.quarantined(retention.reconciled(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("artifact")), known, "artifact"))


@query("""SELECT product, "left", "right" FROM (SELECT o_custkey AS product, o_orderkey AS "right", lag(o_orderkey) OVER w AS "left", lead(o_orderkey) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE nx IS NULL AND "left" IS NOT NULL""")
def last_two_versions(spark, sf_dir):
    """What a watch cycle compares when a source has a new version."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), "o_orderkey", "o_orderdate")
    return versions.last_two(own, "product", "o_orderkey", "o_orderdate", "o_orderkey")


@query("SELECT l_orderkey AS folder, sha256(string_agg(lower('F' || l_partkey) || chr(9) || sha256(CAST(l_quantity AS BIGINT)::VARCHAR), chr(10) ORDER BY lower('F' || l_partkey), sha256(CAST(l_quantity AS BIGINT)::VARCHAR))) AS fingerprint FROM lineitem GROUP BY ALL")
def folder_fingerprints(spark, sf_dir):
    """Digests of watched folders, whatever the order and case of their names."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("folder"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("name"), F.sha2(F.col("l_quantity").cast("long").cast("string"), 256).alias("sha256"))
    return versions.folder_fingerprint(own, "folder")


@query("SELECT doc_id FROM documents WHERE n_chars % 5 <> 0")
def stable_copies(spark, sf_dir):
    """Files that were the same in two reads."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha256"))
    second = docs.withColumn("sha256", F.when(F.col("n_chars") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return versions.stable(docs, second, ["doc_id"]).select("doc_id")


@query(r"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) GROUP BY ALL")
def token_index(spark, sf_dir):
    """The search index, made anew from its table."""
    return search.index(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH f AS (SELECT l_suppkey AS artifact, l_partkey AS address, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS id FROM lineitem GROUP BY ALL)
 SELECT ps.k, a.id AS left_id, b.id AS right_id FROM (SELECT o_orderkey AS k, o_custkey % 10 AS la, o_orderkey % 200 AS l, o_custkey % 7 AS ra, o_custkey % 200 AS r FROM orders) ps LEFT JOIN f a ON a.artifact = la AND a.address = l LEFT JOIN f b ON b.artifact = ra AND b.address = r""")
def matcher_ingest(spark, sf_dir):
    """Pairs of a matcher with the ids of their functions; an address that is not known has none."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artifact"), F.col("l_partkey").alias("address"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("created"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = table(spark, sf_dir, "orders").select(k.alias("k"), (c % 10).alias("left_artifact"), (k % 200).alias("left"), (c % 7).alias("right_artifact"), (c % 200).alias("right"))
    return store.with_ids(pairs, own).select("k", "left_id", "right_id")


@query("SELECT o_orderkey AS run, c_name AS left_name, split_part(o_custkey || ':' || o_orderkey, ':', 2) AS right_side FROM orders JOIN customer ON CAST(c_custkey AS VARCHAR) = split_part(o_custkey || ':' || o_orderkey, ':', 1)")
def run_scope_join(spark, sf_dir):
    """Comparisons with the build that their scope names first."""
    left, right = canonical.scope_sides(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), left.alias("k"), right.alias("right_side"))
    return runs.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("left_name")), "k").select("run", "left_name", "right_side")


@query("SELECT l_orderkey AS build, l_partkey AS fn, p_name AS name, o_orderdate AS at, coalesce(c_name, 'UNKNOWN') AS release, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 GROUP BY ALL")
def assignment_detail(spark, sf_dir):
    """Assignments with their function, build and, where there is one, release."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("fn")).agg(F.count(F.lit(1)).alias("n"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fn"), F.col("p_name").alias("name"))
    builds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("build"), F.col("o_orderdate").alias("at"), "o_custkey")
    releases = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("release"))
    return lines.join(part, "fn").join(builds, "build").join(releases, "o_custkey", "left").select("build", "fn", "name", "at", F.coalesce("release", F.lit("UNKNOWN")).alias("release"), "n")


@query("SELECT o_orderkey AS run, o_orderpriority AS pack, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS reproducible FROM orders WHERE o_orderpriority <> '5-LOW'")
def reproduction_guard(spark, sf_dir):
    """Runs whose very engine pack is still installed."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("pack"))
    packs = spark.createDataFrame([("1-URGENT", "a"), ("2-HIGH", "b"), ("3-MEDIUM", "c"), ("4-NOT SPECIFIED", "d")], "pack string, manifest string")
    there = spark.createDataFrame([("1-URGENT", "a"), ("2-HIGH", "x"), ("3-MEDIUM", "c")], "pack string, manifest string")
    return store.reproducible(runs, packs, there)


@query("SELECT DISTINCT o_orderkey AS run, l_partkey AS artifact FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def artifacts_in_use(spark, sf_dir):
    """Inputs of the runs that jobs are at work on: their hashes are exploded and joined, not searched in text."""
    inputs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("inputs"))
    busy = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return inputs.join(busy, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("run"), F.explode("inputs").alias("artifact"))


@query("SELECT DISTINCT l_partkey AS processor, p_type AS feature FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'")
def run_features(spark, sf_dir):
    """The feature schemas that the functions of a run's results have."""
    own = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return own.join(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("processor"), F.col("p_type").alias("feature")).distinct()


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INT) AS place FROM orders WHERE contains(o_custkey || ':' || o_orderkey, '1:')")
def runs_list(spark, sf_dir):
    """Runs whose scope holds a text, the latest of each product first."""
    o = table(spark, sf_dir, "orders").where(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).contains("1:"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).alias("place"))


@query("SELECT l_orderkey AS run, count(*) AS n_nodes, count(DISTINCT l_suppkey) AS n_processors, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS outcomes, min(l_shipdate) AS started, max(l_shipdate) AS finished FROM lineitem GROUP BY ALL")
def run_info(spark, sf_dir):
    """What a report says of its run."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"))
    return own.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("l_suppkey").alias("n_processors"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("outcomes"), F.min("l_shipdate").alias("started"), F.max("l_shipdate").alias("finished"))


@query("SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS INT) AS place, o_orderpriority AS component, o_orderstatus AS dimension, CASE WHEN length(CAST(o_orderdate AS VARCHAR)) > 10 THEN CAST(o_orderdate AS VARCHAR)[1:10] || '…' ELSE CAST(o_orderdate AS VARCHAR) END AS summary FROM orders")
def changes_list(spark, sf_dir):
    """Changes of a run by component and dimension, shortened for a list."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderstatus", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).alias("place"), F.col("o_orderpriority").alias("component"), F.col("o_orderstatus").alias("dimension"), canonical.shortened(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), 10).alias("summary"))


@query("SELECT p_partkey, concat_ws(',', 'size=' || p_size) AS metrics FROM part")
def public_metrics(spark, sf_dir):
    """Metrics of a report without the sensitive ones."""
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("strings_added"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(canonical.public_metrics(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metrics"))


@query("""WITH m AS (SELECT page_id, page_id % 20 AS archive, CASE page_id % 9 WHEN 0 THEN '/abs' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'C:x' WHEN 3 THEN 'Same' WHEN 4 THEN 'same' ELSE 'n' || page_id END AS name, length(html) AS bytes, length(html) // (1 + page_id % 40) AS packed, page_id % 31 = 5 AS encrypted, page_id % 37 = 6 AS link FROM pages),
 w AS (SELECT *, row_number() OVER (PARTITION BY archive, lower(name) ORDER BY page_id) > 1 AS again, sum(bytes) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY archive ORDER BY page_id) AS n FROM m)
 SELECT page_id, CASE WHEN starts_with(name, '/') OR name = 'a/../b' OR name = 'C:x' THEN 'path' WHEN encrypted THEN 'encrypted' WHEN link THEN 'link' WHEN again THEN 'duplicate' WHEN bytes > 4000 THEN 'size' WHEN bytes > greatest(packed, 1) * 20 THEN 'ratio' WHEN total > 20000 THEN 'total' WHEN n > 12 THEN 'count' END AS problem FROM w""")
def archive_safety(spark, sf_dir):
    """Members that an import must not unpack."""
    i = F.col("page_id")
    name = F.when(i % 9 == 0, "/abs").when(i % 9 == 1, "a/../b").when(i % 9 == 2, "C:x").when(i % 9 == 3, "Same").when(i % 9 == 4, "same").otherwise(F.concat(F.lit("n"), i.cast("string")))
    size = F.length("html")
    members = table(spark, sf_dir, "pages").select("page_id", (i % 20).alias("archive"), i.alias("place"), name.alias("name"), size.alias("bytes"), F.floor(size / (1 + i % 40)).alias("packed"), (i % 31 == 5).alias("encrypted"), (i % 37 == 6).alias("link"))
    return store.members_checked(members, "archive", 12, 4000, 20_000, 20).select("page_id", "problem")
