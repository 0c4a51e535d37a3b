"""Matching, consensus, change, graph and quality queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import changes, consensus, features, graph, lineage, match, quality, store
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


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return features.documents_as_functions(table(spark, sf_dir, "documents"))


FUNCTIONS = r"""
 fn AS (SELECT lang || ':' || source AS component, doc_id AS entry, (doc_id // 20) % 2 AS side, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w, list_distinct(string_split(text, chr(10))) AS lines FROM documents),
 f AS (SELECT *, len(w) AS n, md5(array_to_string(w, '')) AS h, CASE WHEN length(w[1]) >= 4 THEN w[1] END AS name FROM fn),
 l AS (SELECT * FROM f WHERE side = 0), r AS (SELECT * FROM f WHERE side = 1)"""
UNIQUE = """
 ul AS (SELECT component, h, min(entry) AS "left", min(n) AS n FROM l WHERE n > 0 GROUP BY ALL HAVING count(*) = 1), ur AS (SELECT component, h, min(entry) AS "right" FROM r WHERE n > 0 GROUP BY ALL HAVING count(*) = 1),
 u AS (SELECT component, "left", "right" FROM ul JOIN ur USING (component, h) WHERE n >= 3)"""


@query(f"""WITH {FUNCTIONS.replace("lang || ':' || source", "'corpus'")}, {UNIQUE} SELECT component, "left", "right" FROM u""")
def unique_hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique hashes of the whole corpus as one component."""
    whole = F.lit("corpus")
    return match.unique_hash_matches(*(f.withColumn("component", whole) for f in _sides(spark, sf_dir)))


@query(f"""WITH {FUNCTIONS}, {UNIQUE},
 a AS (SELECT component, name, min(entry) AS "left" FROM l WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.component = l.component AND u."left" = l.entry) GROUP BY ALL),
 b AS (SELECT component, name, max(entry) AS "right" FROM r WHERE name IS NOT NULL GROUP BY ALL)
 SELECT component, "left", "right" FROM a JOIN b USING (component, name) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.component = b.component AND u."right" = b."right")""")
def name_match_last_right(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return match.name_matches(left, right, match.unique_hash_matches(left, right))


@query(f"""WITH {FUNCTIONS} SELECT l.component, l.entry AS "left", r.entry AS "right" FROM l JOIN r ON l.component = r.component WHERE least(l.n, r.n) * 3 >= greatest(l.n, r.n) OR abs(l.n - r.n) <= 4""")
def candidate_pairs(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pairs = match.candidates(left.select("component", "entry", "insn_count"), right.select("component", "entry", "insn_count"))
    return pairs.select("component", F.col("l.entry").alias("left"), F.col("r.entry").alias("right"))


@query(f"""WITH {FUNCTIONS}, p AS (
   SELECT l.component, l.entry AS "left", r.entry AS "right", len(list_intersect(l.lines, r.lines)) AS shared, len(l.lines) + len(r.lines) - len(list_intersect(l.lines, r.lines)) AS joint, l.n AS a, r.n AS b
   FROM l JOIN r ON l.component = r.component WHERE least(l.n, r.n) * 3 >= greatest(l.n, r.n) OR abs(l.n - r.n) <= 4)
 SELECT component, "left", "right", CAST(floor(shared / joint * 10000 + 0.000001) AS BIGINT) AS data_score, CAST(floor((1 - abs(a - b) / greatest(a, b, 1)) * 10000 + 0.000001) AS BIGINT) AS ratio FROM p""")
def family_scores(spark, sf_dir):
    """The data-reference family and the size ratio of candidates, in ten thousandths."""
    return match.item_scores(*_sides(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, p AS (
   SELECT l.component, l.entry AS "left", r.entry AS "right", CAST(floor((1 - abs(l.n - r.n) / greatest(l.n, r.n, 1)) * 10000 + 0.000001) AS BIGINT) AS score
   FROM l JOIN r ON l.component = r.component WHERE least(l.n, r.n) * 3 >= greatest(l.n, r.n) OR abs(l.n - r.n) <= 4),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY component, "left" ORDER BY score DESC, "right") AS INT) AS rank, score - lead(score) OVER (PARTITION BY component, "left" ORDER BY score DESC, "right") AS margin FROM p)
 SELECT *, coalesce(margin < 500 AND rank = 1, FALSE) AS ambiguous FROM k WHERE rank <= 3""")
def topk_candidates(spark, sf_dir):
    """The three nearest partners by size, with the margin to the next one."""
    best = match.nearest_by_size(*_sides(spark, sf_dir))
    return best.withColumn("ambiguous", F.coalesce((F.col("margin") < 500) & (F.col("rank") == 1), F.lit(False)))


GREEDY = f"""{FUNCTIONS}, p AS (SELECT l.component, l.entry AS l, r.entry AS r, 1 - abs(l.n - r.n) / greatest(l.n, r.n, 1) AS score FROM l JOIN r ON l.component = r.component WHERE least(l.n, r.n) * 3 >= greatest(l.n, r.n) OR abs(l.n - r.n) <= 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, l, r) AS n FROM p),
 g AS (SELECT component, {{'n': 0::BIGINT, 'l': NULL::BIGINT, 'r': NULL::BIGINT, 'score': NULL::DOUBLE}} AS x, []::BIGINT[] AS ul, []::BIGINT[] AS ur FROM (SELECT DISTINCT component FROM p)
  UNION ALL SELECT component, x, list_append(ul, x.l), list_append(ur, x.r) FROM (
   SELECT g.component, any_value(g.ul) AS ul, any_value(g.ur) AS ur, arg_min({{'n': k.n, 'l': k.l, 'r': k.r, 'score': k.score}}, k.n) AS x FROM g JOIN k ON k.component = g.component AND k.n > g.x.n AND NOT list_contains(g.ul, k.l) AND NOT list_contains(g.ur, k.r) GROUP BY g.component))"""


@query(f"""WITH RECURSIVE {GREEDY} SELECT component, x.l AS "left", x.r AS "right", x.score AS score FROM g WHERE x.n > 0""")
def greedy_assignment(spark, sf_dir):
    """One-to-one assignment of documents by size."""
    return match.greedy_by_size(*_sides(spark, sf_dir))


@query()
def feature_match(spark, sf_dir):
    """The whole matcher: exact, name, two greedy rounds, decisions."""
    with graph.scratch(spark) as work:
        sides = (graph._kept(features.with_callee_names(side)) for side in _sides(spark, sf_dir))  # every step reads features
        return graph.outliving(work, match.match(*sides).select("component", "left", "right", "decision", "score"))[0]


PROPOSALS = """
 p AS (SELECT lang AS component, 'e' || e AS engine, doc_id AS "left", doc_id + 20 * (1 + (doc_id * 7 + e * (doc_id % 3)) % 3) AS "right",
   ['EXACT', 'STRONG', 'PROBABLE', 'AMBIGUOUS', 'UNRESOLVED'][1 + (doc_id * 3 + e * 5 + doc_id // 40) % 5] AS decision,
   list_filter(['cfg', 'instruction', 'identity', 'callgraph'], lambda x, i: ((doc_id + e * 3 + doc_id // 7) >> (i - 1)) % 2 = 1) AS families FROM documents, (VALUES (0), (1), (2)) AS t(e) WHERE (doc_id + e) % 4 <> 0),
 un AS (SELECT lang AS component, doc_id AS "left" FROM documents WHERE doc_id % 11 = 0)"""
CONSENSUS = f"""{PROPOSALS},
 us AS (SELECT *, CASE decision WHEN 'EXACT' THEN 5 WHEN 'STRONG' THEN 4 WHEN 'PROBABLE' THEN 3 WHEN 'AMBIGUOUS' THEN 2 ELSE 0 END AS rank FROM p WHERE decision <> 'UNRESOLVED'),
 per AS (SELECT component, "left", "right", list_sort(list_distinct(flatten(list(families)))) AS families, count(*) AS engines, max(rank) AS rank, bool_or(decision = 'EXACT') AS ex, bool_or(decision = 'AMBIGUOUS') AS amb FROM us GROUP BY ALL),
 o AS (SELECT *, len(families) AS d, row_number() OVER w AS place, count(*) OVER (PARTITION BY component, "left") - 1 AS rivals, lead(len(families)) OVER w AS nd, lead(engines) OVER w AS ne FROM per WINDOW w AS (PARTITION BY component, "left" ORDER BY len(families) DESC, engines DESC, rank DESC, "right")),
 best AS (SELECT *, (SELECT coalesce(max(len(x.families)), 0) FROM o x WHERE x.component = o.component AND x."left" = o."left" AND x.place > 1) >= 2 AS strong FROM o WHERE place = 1),
 dec AS (SELECT f.component, f."left", b."right", CASE WHEN b."right" IS NULL THEN 'UNRESOLVED' WHEN strong THEN 'CONFLICT' WHEN rivals > 0 AND nd = d AND ne = engines THEN 'AMBIGUOUS' WHEN ex THEN 'EXACT' WHEN amb AND engines = 1 THEN 'AMBIGUOUS'
   WHEN d >= 3 AND rivals = 0 AND un."left" IS NULL THEN 'STRONG' WHEN d >= 2 OR rank >= 4 THEN 'PROBABLE' ELSE 'UNRESOLVED' END AS decision, coalesce(d, 0) AS diversity, coalesce(engines, 0) AS engines, coalesce(array_to_string(families, ','), '') AS families,
   b."right" IS NOT NULL AND count(b."right") OVER (PARTITION BY f.component, b."right") > 1 AS merge_candidate
   FROM (SELECT lang AS component, doc_id AS "left" FROM documents) f LEFT JOIN best b USING (component, "left") LEFT JOIN un USING (component, "left")),
 c AS (SELECT component, "left", "right", CASE WHEN merge_candidate AND decision IN ('PROBABLE', 'STRONG') THEN 'AMBIGUOUS' ELSE decision END AS decision, CAST(diversity AS INT) AS diversity, engines, families, merge_candidate FROM dec)"""


def _consensus(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("component"), F.col("doc_id").alias("left"))
    i, e = F.col("left"), F.col("e")
    p = docs.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((i + e) % 4 != 0)
    decisions = F.array(*(F.lit(d) for d in ("EXACT", "STRONG", "PROBABLE", "AMBIGUOUS", "UNRESOLVED")))
    bits = i + e * 3 + F.floor(i / 7)
    families = F.array_compact(F.array(*(F.when(F.shiftright(bits, k) % 2 == 1, f) for k, f in enumerate(("cfg", "instruction", "identity", "callgraph")))))
    p = p.select(
        "component", F.concat(F.lit("e"), e).alias("engine"), "left", (i + 20 * (1 + (i * 7 + e * (i % 3)) % 3)).alias("right"), F.get(decisions, ((i * 3 + e * 5 + F.floor(i / 40)) % 5).cast("int")).alias("decision"), families.alias("families")
    )
    return consensus.consensus(docs, p, docs.where("left % 11 = 0").withColumn("engine", F.lit("e9")))


@query(f'WITH {CONSENSUS} SELECT component, "left", "right", decision, diversity, engines, families FROM c')
def consensus_decisions(spark, sf_dir):
    return _consensus(spark, sf_dir).select("component", "left", "right", "decision", "diversity", "engines", F.array_join("families", ",").alias("families"))


@query(f"""WITH {CONSENSUS} SELECT component, "right", count(*) AS n_left, CAST(count(*) FILTER (WHERE decision = 'AMBIGUOUS') AS BIGINT) AS n_ambiguous FROM c WHERE merge_candidate GROUP BY ALL""")
def merge_candidates(spark, sf_dir):
    own = _consensus(spark, sf_dir).where("merge_candidate")
    return own.groupBy("component", "right").agg(F.count(F.lit(1)).alias("n_left"), F.count_if(F.col("decision") == "AMBIGUOUS").alias("n_ambiguous"))


@query(f"""WITH {CONSENSUS} SELECT lang AS component, doc_id AS "right", 'UNRESOLVED' AS decision FROM documents WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.component = lang AND c."right" = doc_id)""")
def unmatched_right(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("component"), F.col("doc_id").alias("right"))
    return consensus.unmatched_right(docs, _consensus(spark, sf_dir))


@query(f"""WITH {CONSENSUS}, s AS (SELECT component, c.decision, a.n AS la, b.n AS rb FROM c LEFT JOIN (SELECT doc_id, n_chars AS n FROM documents) a ON c."left" = a.doc_id LEFT JOIN (SELECT doc_id, n_chars AS n FROM documents) b ON c."right" = b.doc_id)
 SELECT component, count(*) AS n_left, count(*) FILTER (WHERE decision = 'UNRESOLVED') AS unresolved_left, count(*) FILTER (WHERE decision IN ('STRONG', 'PROBABLE') AND la <> rb) AS modified,
   CAST(coalesce(sum(rb - la) FILTER (WHERE decision IN ('STRONG', 'PROBABLE')), 0) AS BIGINT) AS size_delta FROM s GROUP BY ALL""")
def structural_change(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return changes.structural(_consensus(spark, sf_dir), docs.select(F.col("doc_id").alias("left"), F.col("n_chars").alias("l_size")), docs.select(F.col("doc_id").alias("right"), F.col("n_chars").alias("r_size")))


def _supplied(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(v, component) USING KEY (v) AS (SELECT DISTINCT a, a FROM u UNION
 SELECT u.a, min(c.component) FROM cc AS c JOIN u ON u.b = c.v JOIN recurring.cc AS k ON k.v = u.a WHERE c.component < k.component GROUP BY u.a)
SELECT v, component, count(*) OVER (PARTITION BY component) AS size FROM cc
""")
def modified_clusters_whole(spark, sf_dir):
    """Connected components of suppliers and parts over all orders, each with its size."""
    out = graph.components(_supplied(table(spark, sf_dir, "lineitem")))
    return out.join(out.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 10000000 + 100000 * year(o_orderdate) + 1000 * month(o_orderdate) + CAST(floor(o_totalprice / 20000) AS BIGINT) AS b FROM orders),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(v, component) USING KEY (v) AS (SELECT DISTINCT a, a FROM u UNION
 SELECT u.a, min(c.component) FROM cc AS c JOIN u ON u.b = c.v JOIN recurring.cc AS k ON k.v = u.a WHERE c.component < k.component GROUP BY u.a),
g AS (SELECT component, count(*) AS size, min(v) AS first_member FROM cc GROUP BY component)
SELECT row_number() OVER (ORDER BY size DESC, first_member) AS place, component, size FROM g
""")
def clusters_by_size(spark, sf_dir):
    """Components of customers and what they bought alike in a month: the largest first, of equals that with the least member."""
    own = table(spark, sf_dir, "orders")
    kind = 10_000_000 + 100_000 * F.year("o_orderdate") + 1000 * F.month("o_orderdate") + F.floor(F.col("o_totalprice") / 20000)
    out = graph.components(own.select(F.col("o_custkey").alias("a"), kind.cast("long").alias("b")))
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size"))  # a component is named by its least member
    return store.numbered(sizes, F.desc("size"), F.asc("component"), name="place").select("place", "component", "size")




@query("""
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
d(v) AS (SELECT 'r0' UNION SELECT child FROM d JOIN e ON v = parent) SELECT v FROM d
""")
def stale_closure(spark, sf_dir):
    """All that derives from the first region: what one changed input makes stale."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    b = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    c = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("parent"), name("o", "o_orderkey").alias("child"))
    return graph.descendants(a.unionByName(b).unionByName(c), spark.createDataFrame([("r0",)], "v string"))


POINTS = "pt AS (SELECT CASE WHEN d.lang = 'en' THEN 'en' ELSE 'other' END AS engine, CAST(least(d.n_chars, 9999) // 100 AS DOUBLE) / 100 AS score, l.quality = 1 AS ok FROM labels l JOIN documents d USING (doc_id))"


def _points(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    own = table(spark, sf_dir, "labels").join(docs, "doc_id")
    score = F.floor(F.least("n_chars", F.lit(9999)) / 100).cast("double") / 100
    return own.select(F.when(F.col("lang") == "en", "en").otherwise("other").alias("engine"), score.alias("score"), (F.col("quality") == 1).alias("ok"))


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY score, ok) AS i FROM pt),
 s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY engine ORDER BY i) AS c FROM r),
 m AS (SELECT a.engine, a.i, j.i AS j, min((k.c - j.c + j.ok::INT) / (k.i - j.i + 1)) AS low FROM s a JOIN s j ON a.engine = j.engine AND j.i <= a.i JOIN s k ON a.engine = k.engine AND k.i >= a.i GROUP BY ALL),
 f AS (SELECT engine, i, max(low) AS fit FROM m GROUP BY ALL),
 x AS (SELECT *, abs(sum(ok::INT - fit) OVER (PARTITION BY engine, fit ORDER BY i)) < 0.000001 AS ends FROM f JOIN r USING (engine, i)),
 b AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY engine, fit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM x)
 SELECT engine, max(score) AS upper, CAST(floor(fit * 1000000 + 0.0001) AS BIGINT) AS precision_ppm, count(*) AS n FROM b GROUP BY engine, fit, block""")
def calibration_pav(spark, sf_dir):
    out = quality.pooled(_points(spark, sf_dir), ["engine"], digits=None)
    return out.select("engine", "upper", F.floor(F.col("precision") * 1000000 + 0.0001).cast("long").alias("precision_ppm"), "n")


@query(f"WITH {POINTS} SELECT CAST(b AS INT) AS bin, count(score) AS n, count(*) FILTER (WHERE ok) AS good FROM range(10) t(b) LEFT JOIN pt ON least(floor(score * 10), 9) = b GROUP BY ALL")
def reliability_diagram(spark, sf_dir):
    return quality.reliability(_points(spark, sf_dir))


@query(f"""WITH {POINTS}, p AS (SELECT engine, CASE WHEN ok THEN 'A' ELSE 'B' END AS context, nullif(score, 0.05) AS score FROM pt),
 d AS (SELECT *, CASE WHEN engine = 'en' AND context = 'A' AND score IS NOT NULL THEN 'CALIBRATED' WHEN engine = 'en' THEN 'OUT_OF_DISTRIBUTION' ELSE 'UNCALIBRATED' END AS state FROM p)
 SELECT *, CASE WHEN state = 'CALIBRATED' THEN CAST(CASE WHEN score <= 0.1 THEN 0.25 WHEN score <= 0.5 THEN 0.5 ELSE 0.75 END AS DOUBLE) END AS probability, state = 'OUT_OF_DISTRIBUTION' AS abstain FROM d""")
def calibration_display(spark, sf_dir):
    """Raw scores as probabilities where the newest validated profile of their context covers them."""
    scores = _points(spark, sf_dir).select("engine", F.nullif("score", F.lit(0.05)).alias("score"), F.when(F.col("ok"), "A").otherwise("B").alias("context"))
    steps, old = [(0.1, 0.25, 10), (0.5, 0.5, 10), (0.9, 0.75, 10)], [(0.9, 0.1, 10)]
    kind = "engine string, context string, validated boolean, created int, mapping array<struct<upper: double, precision: double, n: int>>"
    profiles = spark.createDataFrame([("en", "A", True, 2, steps), ("en", "A", True, 1, old), ("en", "A", False, 3, old), ("en", "B", False, 1, steps)], kind)
    return quality.displayed(scores, profiles, abstain=True)


@query(f"""WITH {POINTS}, c AS (SELECT engine, count(*) FILTER (WHERE score >= 0.1 AND ok) AS tp, count(*) FILTER (WHERE score >= 0.1 AND NOT ok) AS fp, count(*) FILTER (WHERE score < 0.1 AND ok) AS fn FROM pt GROUP BY ALL)
 SELECT engine, tp, fp, fn, CAST(floor(tp / (tp + fp) * 1000000 + 0.0001) AS BIGINT) AS p_ppm, CAST(floor(tp / (tp + fn) * 1000000 + 0.0001) AS BIGINT) AS r_ppm FROM c""")
def precision_recall(spark, sf_dir):
    from ..functions.stats import precision_recall as prf

    c = _points(spark, sf_dir).groupBy("engine").agg(*(F.count_if(x).alias(n) for n, x in (("tp", (F.col("score") >= 0.1) & F.col("ok")), ("fp", (F.col("score") >= 0.1) & ~F.col("ok")), ("fn", (F.col("score") < 0.1) & F.col("ok")))))
    p, r, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("engine", "tp", "fp", "fn", *(F.floor(x * 1000000 + 0.0001).cast("long").alias(n) for n, x in (("p_ppm", p), ("r_ppm", r))))


@query(f"WITH {POINTS} SELECT engine, CAST(floor(score * 10) AS INT) AS decision, count(*) AS n, count(*) FILTER (WHERE ok) AS correct FROM pt GROUP BY ALL")
def precision_by_class(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("engine", F.floor(F.col("score") * 10).cast("int").alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("correct"))


@query("SELECT step, CASE WHEN (dense_rank() OVER (ORDER BY step) - 1) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) || ':' || o_orderstatus AS step FROM orders)")
def benchmark_split(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus").alias("step")).distinct()
    return quality.split_by_parity(own, "step")


@query("""WITH h AS (SELECT doc_id % 2 AS half, avg(quality) AS p, avg(toxic) AS r, 1 - avg(quality) AS f FROM labels GROUP BY ALL),
 v AS (SELECT half, unnest(['precision', 'recall', 'false_new_rate']) AS metric, unnest([p, r, f]) AS value FROM h)
 SELECT b.metric, CASE WHEN b.metric = 'false_new_rate' THEN c.value - b.value ELSE b.value - c.value END <= 0.02 AS ok FROM v b JOIN v c ON b.metric = c.metric AND b.half = 0 AND c.half = 1""")
def regression_gates(spark, sf_dir):
    h = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 2).alias("half")).agg(F.avg("quality").alias("precision"), F.avg("toxic").alias("recall"), (1 - F.avg("quality")).alias("false_new_rate"))
    v = h.unpivot("half", ["precision", "recall", "false_new_rate"], "metric", "value")
    return quality.gates(v.where("half = 1"), v.where("half = 0")).select("metric", "ok")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS run, o_orderpriority AS signature FROM orders), n AS (SELECT run, list_sort(list(signature)) AS sig FROM s GROUP BY ALL)
 SELECT a.run AS a, b.run AS b, CASE WHEN a.sig = b.sig THEN 'FULL' WHEN len(list_intersect(a.sig, b.sig)) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS comparability FROM n a JOIN n b ON b.run = a.run + 1""")
def run_comparability(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("signature"))
    own = runs.select("run").distinct()
    pairs = own.select(F.col("run").alias("a"), (F.col("run") + 1).alias("b")).join(own.withColumnRenamed("run", "b"), "b", "left_semi")
    return quality.comparability(runs, pairs).select("a", "b", "comparability")


@query("""SELECT c_nationkey AS workspace, CASE WHEN count(DISTINCT c_custkey) <= 25 AND count(o_orderkey) <= 50000 THEN 'S' WHEN count(DISTINCT c_custkey) <= 250 AND count(o_orderkey) <= 1000000 THEN 'M' WHEN count(DISTINCT c_custkey) <= 2500 AND count(o_orderkey) <= 10000000 THEN 'L' ELSE 'XL' END AS class
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def capacity_class(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_nationkey").alias("workspace")).agg(F.count(F.lit(1)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("f"))
    return own.select("workspace", quality.capacity_class(F.col("b"), F.col("f")).alias("class"))


@query("""SELECT p_partkey AS artifact, 'architecture=' || coalesce(CASE p_size % 3 WHEN 0 THEN 'x64' WHEN 1 THEN 'x86' END, 'None') || '|format=' || p_brand || '|size_bucket=' || CASE WHEN p_size <= 10 THEN 'S' WHEN p_size <= 25 THEN 'M' WHEN p_size <= 40 THEN 'L' ELSE 'XL' END AS context FROM part""")
def context_key(spark, sf_dir):
    arch = F.when(F.col("p_size") % 3 == 0, "x64").when(F.col("p_size") % 3 == 1, "x86")
    key = scalar.context_key(architecture=arch, format=F.col("p_brand"), size_bucket=scalar.bucket(F.col("p_size"), {"S": 10, "M": 25, "L": 40}))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact"), key.alias("context"))


DIMENSIONS = """
 t AS (SELECT o_custkey AS product, o_orderkey AS version, o_totalprice, o_orderstatus, o_orderdate, lag(o_orderkey) OVER w AS before, lag(o_totalprice) OVER w AS p0, lag(o_orderstatus) OVER w AS s0, lag(o_orderdate) OVER w AS d0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {DIMENSIONS}
 SELECT product, version, 'BINARY' AS dimension, 'MEASURED' AS state, CAST(floor(o_totalprice) - floor(p0) AS BIGINT) AS metric FROM t WHERE before IS NOT NULL
 UNION ALL SELECT product, version, 'BUILD', 'MEASURED', CAST(o_orderstatus <> s0 AS BIGINT) FROM t WHERE before IS NOT NULL
 UNION ALL SELECT product, version, 'STRUCTURAL', CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'NOT_MEASURED' ELSE 'MEASURED' END, a.n - b.n FROM t LEFT JOIN n a ON version = a.l_orderkey LEFT JOIN n b ON before = b.l_orderkey WHERE before IS NOT NULL
 UNION ALL SELECT product, version, 'DEPLOYMENT', 'MEASURED', date_diff('day', CAST(d0 AS DATE), CAST(o_orderdate AS DATE)) FROM t WHERE before IS NOT NULL""")
def change_dimensions_long(spark, sf_dir):
    """One row per transition and dimension; what is not measured is null, not zero, and dimensions stay apart."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    before = {c: F.lag(c).over(w).alias(f"{c}_0") for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "n")}
    t = own.select("*", *before.values()).where("o_orderkey_0 IS NOT NULL")
    metrics = {
        "BINARY": (F.floor("o_totalprice") - F.floor("o_totalprice_0")).cast("long"), "BUILD": (F.col("o_orderstatus") != F.col("o_orderstatus_0")).cast("long"),
        "STRUCTURAL": F.col("n") - F.col("n_0"), "DEPLOYMENT": F.datediff("o_orderdate", "o_orderdate_0").cast("long"),
    }
    return changes.dimensions(t, [F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("version")], metrics)


@query("""WITH c AS (SELECT o_custkey AS product, count(*) AS applicable, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok FROM orders GROUP BY ALL)
 SELECT *, CASE WHEN ok / applicable < 0.6 THEN 'LOW' WHEN ok < applicable THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM c""")
def reliability_level(spark, sf_dir):
    """How far the comparisons of each product can be relied on, by what was measured."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("product")).agg(F.count(F.lit(1)).alias("applicable"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    none = F.lit(None).cast("double")
    return own.withColumn("level", changes.reliability_level(F.try_divide("ok", "applicable"), F.col("applicable") - F.col("ok"), none, F.lit(0)))


@query("""SELECT conv_id AS lineage, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS relations, arg_min(role, turn) AS first_relation, min(turn) AS first_turn FROM conversations GROUP BY ALL""")
def lineage_summary(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("lineage"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("relations"), F.min_by("role", "turn").alias("first_relation"), F.min("turn").alias("first_turn"))


@query(r"""WITH x AS (SELECT doc_id, i, regexp_extract(line, '[0-9]{4,}') AS found FROM (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)))
 SELECT doc_id, CAST(i - 1 AS INT) AS line, last_value(nullif(found, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pending FROM x""")
def carried_forward_dates(spark, sf_dir):
    """The last number seen, carried to the lines after it."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    found = F.nullif(F.regexp_extract("t", "[0-9]{4,}", 0), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "line", F.last(found, ignorenulls=True).over(w).alias("pending"))


@query(f"""WITH {CONSENSUS} SELECT c.component AS role, c."left" AS left_address, c."right" AS right_address, '0x' || lower(hex(c."left")) AS shown, c.decision, CASE WHEN c.decision IN ('EXACT', 'STRONG') THEN 'HIGH' WHEN c.decision = 'PROBABLE' THEN 'MEDIUM' ELSE 'LOW' END AS strength,
 coalesce(d.source, 'UNKNOWN') AS right_source FROM c LEFT JOIN documents d ON d.doc_id = c."right" AND d.lang = c.component""")
def report_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("component"), F.col("doc_id").alias("right"), "source")
    out = _consensus(spark, sf_dir).join(docs, ["component", "right"], "left")
    return out.select(
        F.col("component").alias("role"), F.col("left").alias("left_address"), F.col("right").alias("right_address"), scalar.hex_address(F.col("left")).alias("shown"), "decision", "strength", F.coalesce("source", F.lit("UNKNOWN")).alias("right_source")
    )


def _lineage_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as functions of four builds for each source; a function is matched to its successor."""
    docs = table(spark, sf_dir, "documents")
    left, right = features.documents_as_functions(docs)
    fn = left.unionByName(right).withColumn("v", F.floor(F.col("entry") / 20) % 4)
    product, name = F.split_part("component", F.lit(":"), F.lit(2)), lambda c: c.cast("string")
    functions = fn.select(
        product.alias("product"), F.concat(F.lit("b"), name(F.col("v"))).alias("build"), name(F.col("entry")).alias("fn"), F.col("normalized_hash").alias("hash"), "insn_count", "mnemonics", "cfg_blocks", "cfg_edges", "cyclomatic", "cfg_hash",
        F.array(name(F.col("entry") + 80)).alias("callees"), F.array(name(F.col("entry") - 80)).alias("callers"), "callee_names", "imports", "strings", "constants", "name", "size",
    )
    builds = functions.select("product", "build").distinct().withColumn("ord", F.substring("build", 2, 9).cast("int") + 1)
    i = F.col("entry")
    decision = F.get(F.array(*(F.lit(d) for d in ("EXACT", "STRONG", "PROBABLE", "AMBIGUOUS", "UNRESOLVED"))), (F.floor(i / 20) % 5).cast("int"))
    own = fn.where("v < 3").select(
        product.alias("product"), F.concat(F.lit("b"), name(F.col("v"))).alias("left_build"), F.concat(F.lit("b"), name(F.col("v") + 1)).alias("right_build"), name(i).alias("left"), name(i + 20).alias("successor"), decision.alias("decision"), (i % 4).cast("int").alias("diversity")
    )
    there = functions.select("product", F.col("fn").alias("successor"))
    matched = F.col("decision") != "UNRESOLVED"
    offers = F.array(F.struct(F.col("successor").alias("other"), F.lit(0.7).alias("score")))
    claims = own.join(there, ["product", "successor"]).select("product", "left_build", "right_build", "left", F.when(matched, F.col("successor")).alias("right"), "decision", "diversity", F.lit(False).alias("merge_candidate"), offers.alias("candidates"))
    taken = claims.where("right IS NOT NULL").select("product", "right")
    rest = functions.where("build <> 'b0'").select("product", F.col("build").alias("right_build"), F.col("fn").alias("right")).join(taken, ["product", "right"], "left_anti")
    lone = rest.select(
        "product", F.concat(F.lit("b"), (F.substring("right_build", 2, 9).cast("int") - 1).cast("string")).alias("left_build"), "right_build", F.lit(None).cast("string").alias("left"), "right", F.lit("UNRESOLVED").alias("decision"), F.lit(0).alias("diversity"), F.lit(False).alias("merge_candidate"),
        F.array(F.struct((F.col("right").cast("long") - 20).cast("string").alias("other"), F.lit(0.5).alias("score"))).alias("candidates"),
    )
    return builds, functions, claims.unionByName(lone)


@query()
def lineage_fold(spark, sf_dir):
    """Lineages of documents over four builds of each source: relations by build."""
    builds, functions, matches = _lineage_inputs(spark, sf_dir)
    out = lineage.fold(builds, functions, matches)  # the fold writes the features once; builds and matches need none of them
    return out.groupBy("product", "build", "relation").agg(F.count(F.lit(1)).alias("n"))


GRADED = """
 fn AS (SELECT source AS product, CAST(doc_id AS VARCHAR) AS fn, doc_id, (doc_id // 20) % 4 AS v, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w, string_split(text, chr(10)) AS ls FROM documents),
 f AS (SELECT *, len(w) AS n, md5(array_to_string(w, '')) AS h, CASE WHEN length(w[1]) >= 4 THEN w[1] END AS name, list_distinct(ls) AS items, len(ls) AS b, len(list_distinct(w)) AS e, list_distinct(list_filter(w, lambda x: length(x) >= 12)) AS imports FROM fn WHERE (doc_id // 20) % 4 IN (0, 3)),
 cnt AS (SELECT product, fn, v, word, count(*) AS k FROM (SELECT product, fn, v, unnest(w) AS word FROM f) GROUP BY ALL), nrm AS (SELECT fn, sqrt(sum(k * k)::DOUBLE) AS norm FROM cnt GROUP BY ALL),
 dot AS (SELECT a.fn AS o, b.fn AS n, sum(a.k * b.k)::DOUBLE AS d FROM cnt a JOIN cnt b ON a.product = b.product AND a.word = b.word AND a.v = 0 AND b.v = 3 GROUP BY ALL),
 x AS (SELECT o.product, o.fn AS lineage, n.fn, o.n AS so, n.n AS sn, o.h = n.h AND o.n > 0 AND n.n > 0 AS same, coalesce(d.d / nullif(no.norm * nn.norm, 0), 0) AS cos, 1 - abs(o.n - n.n) / greatest(o.n, n.n, 1) AS ratio,
   0.3 * ((1 - abs(o.b - n.b) / greatest(o.b, n.b, 1)) + (1 - abs(o.e - n.e) / greatest(o.e, n.e, 1)) + (1 - abs(greatest(1, o.e - o.b + 2) - greatest(1, n.e - n.b + 2)) / greatest(1, o.e - o.b + 2, n.e - n.b + 2))) AS cfg,
   len(list_intersect(o.imports, n.imports)) AS ii, len(o.imports) + len(n.imports) AS it, len(list_intersect(o.items, n.items)) AS di, len(o.items) AS do_, len(n.items) AS dn, o.name AS a, n.name AS z
   FROM f o JOIN f n ON o.product = n.product AND o.v = 0 AND n.v = 3 LEFT JOIN dot d ON d.o = o.fn AND d.n = n.fn LEFT JOIN nrm no ON no.fn = o.fn LEFT JOIN nrm nn ON nn.fn = n.fn),
 y AS (SELECT *, round(CASE WHEN same THEN 1.0 ELSE cos * sqrt(ratio) END, 4) AS i, round(cfg, 4) AS c, round(coalesce((ii / nullif(it - ii, 0) + 1) / 2, 1), 4) AS g, round(di / (do_ + dn - di), 4) AS d4, CASE WHEN do_ >= 2 AND dn >= 2 THEN di / (do_ + dn - di) END AS data, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN a = z END AS named FROM x),
 s AS (SELECT *, round((0.35 * i + 0.25 * c + 0.15 * g + 0.15 * d4 + coalesce(0.1 * named::INT, 0)) / (0.9 + CASE WHEN named IS NULL THEN 0 ELSE 0.1 END), 4) AS score, coalesce(data < 0.3, FALSE) OR coalesce(NOT named, FALSE) AS contradicted FROM y)"""


@query(f"""WITH {GRADED} SELECT product, lineage, fn, CASE WHEN NOT contradicted AND (least(so, sn) >= 8 AND (same OR (0.35 * i + 0.25 * c) / 0.6 >= 0.85) OR score >= 0.75) THEN 'CANDIDATE' ELSE 'REJECTED' END AS status, contradicted FROM s""")
def resurrection_assess(spark, sf_dir):
    """Every graded pairing of a function of the first build with one of the last, by source."""
    _, functions, _ = _lineage_inputs(spark, sf_dir)
    functions = functions.withColumn("constants", F.array().cast("array<string>"))  # items are lines here, as in the SQL
    old = lineage._structs(functions.where("build = 'b0'"), "old").withColumnRenamed("old_fn", "lineage")
    new = lineage._structs(functions.where("build = 'b3'"), "new").withColumnRenamed("new_fn", "fn")
    return lineage.graded_pairs(old, new)


CAPACITY = "c AS (SELECT l_suppkey AS build, 4096 + 16 * (l_orderkey * 8 + l_linenumber) AS address, CASE WHEN l_partkey % 50 = 0 THEN 'fn_' || l_orderkey END AS name, sha256(CAST(l_partkey AS VARCHAR)) AS hash FROM lineitem)"


def _capacity(spark, sf_dir) -> DataFrame:
    """Line items as function rows: suppliers are builds, parts are code, and one in fifty has a name."""
    own = table(spark, sf_dir, "lineitem")
    return own.select(
        F.col("l_suppkey").alias("build"), (4096 + 16 * (F.col("l_orderkey") * 8 + F.col("l_linenumber"))).alias("address"), F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("fn_"), F.col("l_orderkey").cast("string"))).alias("name"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"),
    )


@query(f"WITH {CAPACITY} SELECT build, count(*) AS n, count(DISTINCT hash) AS n_hash, count(name) AS n_named FROM c GROUP BY ALL")
def capacity_load(spark, sf_dir):
    """All function rows written to a store and counted by build as they are read back."""
    held = graph.Scratch(spark).keep(_capacity(spark, sf_dir))
    return held.groupBy("build").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("n_hash"), F.count("name").alias("n_named"))


@query(f"WITH {CAPACITY} SELECT build, address, name FROM c WHERE contains(name, '995')")
def capacity_search(spark, sf_dir):
    """All hits of a substring search over the names of function rows."""
    return _capacity(spark, sf_dir).where(F.col("name").contains("995")).select("build", "address", "name")
