"""Line dedup over overlapping windows of three lines, with DataFrame functions only.

Every three consecutive lines (blank ones passed over, the rest trimmed of spaces) are hashed to
128 bits. A window that occurs more than once in the corpus keeps its first occurrence whole, by doc_id
and then line; the lines that later occurrences cover are removed, their spans merged. Where a later
occurrence overlaps the first one in its own document, only the lines behind the first one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, meeting, staged, table

WINDOW = 3


def _windows(text: Column) -> Column:
    """struct(s, e, h1, h2) for each window: its first and last line, and its hash."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t")))
    return F.filter(numbered, lambda x: x["t"] != "")


def _hashed(lines: Column) -> Column:
    def one(k: Column) -> Column:
        own = F.concat_ws("\n", *(F.get(lines, k + j)["t"] for j in range(WINDOW)))
        return F.struct(
            F.get(lines, k)["i"].alias("s"), F.get(lines, k + WINDOW - 1)["i"].alias("e"), F.xxhash64(F.lit(1), own).alias("h1"), F.xxhash64(F.lit(2), own).alias("h2")
        )

    empty = F.array().cast("array<struct<s:int,e:int,h1:bigint,h2:bigint>>")
    return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), one)).otherwise(empty)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per (doc_id, _key) with lines to remove: the positions of those lines. Windows that occur hot times or more
    meet their occurrences by broadcast."""
    lines = docs.select("doc_id", "_key", _windows(F.col("_text")).alias("_lines"))
    found = lines.select("doc_id", "_key", F.explode_outer(_hashed(F.col("_lines"))).alias("w")).select("doc_id", "_key", "w.*").where("h1 IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key", "s", "e")
    again = staged(found.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated")
    later = meeting(found, again, ["h1", "h2"], ["doc_id", "_key", "s"], hot=hot).where(place > F.col("_first"))
    own = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_key") == F.col("_first._key"))
    later = later.withColumn("s", F.when(own, F.greatest("s", F.col("_first.e") + 1)).otherwise(F.col("s"))).where("s <= e")
    spans = later.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("s", "e")).alias("_spans"))
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda x: F.sequence(x["s"], x["e"]))))
    return spans.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), covered.alias("_covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows with their text less its repeated lines, and n_lines and n_removed.

    Lines end at \\n; blank lines form no window but go with the span around them. Texts of fewer
    than three lines are never changed. Null stays null, with no lines; an empty text has one line.
    Ids may be of any type that has an order. Rows with one id and one text are one document and share
    its result; rows without an id come last, and of these, or of rows that repeat an id, the order of a
    hash of the text decides. Columns other than id and text pass through; of these n_lines and
    n_removed are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", text_col)]
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    own = docs.select(key.alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    own = own.withColumn("_key", F.xxhash64("_text"))
    spans = repeated_spans(own, hot)
    rows = docs.select(F.struct(*kept).alias("_row"), text.alias("_text"), key.alias("_doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    rows = rows.join(spans, rows["_doc"].eqNullSafe(spans["_id"]) & (rows["_hash"] == spans["_k"]), "left")
    # a projection of its own: inside the lambda below the text would be split again for every line
    rows = rows.select("_row", "_text", "_covered", F.split("_text", "\n").alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    cut = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    some = F.size(F.coalesce("_covered", F.array().cast("array<int>"))) > 0
    order = [F.col(f"_row.`{c}`") if c != text_col else F.when(some, cut).otherwise(F.col("_text")).alias(text_col) for c in docs.columns if c not in ("n_lines", "n_removed")]
    count = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines")
    return rows.select(*order, count, F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH l AS (
  SELECT doc_id, text, i - 1 AS i, lines[i] AS raw
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
n AS (SELECT doc_id, i, trim(raw, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(raw, ' ') <> ''),
w AS (
  SELECT a.doc_id, a.i AS s, c.i AS e, a.t || chr(10) || b.t || chr(10) || c.t AS win
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN n c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
r AS (SELECT doc_id, s, e, row_number() OVER o AS nth, first_value(doc_id) OVER o AS first_doc, first_value(e) OVER o AS first_e FROM w WINDOW o AS (PARTITION BY win ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(s, first_e + 1) ELSE s END, e + 1)) AS t(i) WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
