"""What is near by its bytes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..operators.graph import _kept
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

DIGESTS = """
 h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE octet_length(encode(text)) >= 3),
 b AS (SELECT doc_id, generate_subscripts(l, 1) AS i, CAST('0x' || unnest(l) AS INT) AS v FROM h),
 g AS (SELECT doc_id, v AS b0, lead(v) OVER w AS b1, lead(v, 2) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 c AS (SELECT doc_id, (5 * b0 + 37 * b1 + 101 * b2) % 128 AS bucket, count(*) AS n FROM g WHERE b2 IS NOT NULL GROUP BY ALL),
 f AS (SELECT d.doc_id, k AS bucket, coalesce(c.n, 0) AS n FROM (SELECT doc_id FROM h) d CROSS JOIN range(128) t(k) LEFT JOIN c ON c.doc_id = d.doc_id AND c.bucket = k),
 o AS (SELECT doc_id, list_sort(list(n)) AS s FROM f GROUP BY doc_id),
 q AS (SELECT f.doc_id, list((n > s[32])::INT + (n > s[64])::INT + (n > s[96])::INT ORDER BY bucket) AS code FROM f JOIN o USING (doc_id) GROUP BY f.doc_id),
 heads AS (SELECT code, min(doc_id) AS head FROM q GROUP BY code)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {DIGESTS}, p AS (SELECT x.head AS a, y.head AS b, list_sum(list_transform(list_zip(x.code, y.code), lambda z: abs(z[1] - z[2]))) AS d FROM heads x JOIN heads y ON x.head < y.head)
 SELECT a, b, CAST(d AS INT) AS distance FROM p WHERE d <= 11""")
def fuzzy_pairs(spark, sf_dir):
    """Documents whose bytes are nearly alike: pairs of classes of one digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fuzzy.digest(F.encode("text", "UTF-8")).alias("digest"))
    return fuzzy.near(_kept(docs), "doc_id")[0]


@query(f"WITH {DIGESTS} SELECT q.doc_id, head FROM q JOIN heads USING (code)")
def fuzzy_classes(spark, sf_dir):
    """The class of one digest that each document is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fuzzy.digest(F.encode("text", "UTF-8")).alias("digest"))
    return fuzzy.near(_kept(docs), "doc_id")[1].withColumnRenamed("key", "doc_id")
