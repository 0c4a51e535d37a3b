"""Exact dedup by skew-safe combining, with DataFrame functions only.

Rows are combined three times, and each time the whole normalised text is part of the key,
so a digest collision never merges two texts:

1. locally, in the map tasks (the partial aggregate below the first exchange);
2. per (digest, text, salt): a text that a third of all rows share meets in `salts` tasks;
3. per (digest, text): at most `salts` winners of a text meet.

Winners then go back to all rows over the digest, those of frequent texts by broadcast, as their counts are
known by then. This moves ids and digests, no texts, and no task gets all rows of a frequent text.
Rows that are alike in id and text are counted before and multiplied after it; one of them stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, meeting, staged, table

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without any of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=None, hot: int = HOT) -> DataFrame:
    """One row per input row: its id, the id that stays for its text, group size, kept, digest.

    Of equal normalised texts the row with the most code points in its original text stays, then
    the smallest id (a null id comes last), then the smallest hash of the original text; of rows that are
    alike in all of these, one. Null, empty and all-white texts are one group. Other columns are ignored,
    whatever their names. An empty table gives no rows.

    digest: Column -> Column, SHA-256 by default. With a weaker one, rows find their winner by
    digest and text together; with SHA-256, two texts with one digest raise an error.
    """
    strong = digest is None
    digest = digest or (lambda norm: F.sha2(norm, 256))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = own.select("doc_id", F.length("_text").alias("_points"), F.xxhash64("_text").alias("_raw"), normalised(F.col("_text")).alias("_norm"))
    rows = rows.select("doc_id", "_points", "_raw", "_norm", digest(F.col("_norm")).alias("_digest"), F.pmod(F.xxhash64("doc_id", "_raw"), F.lit(salts)).alias("_salt"))

    order = F.struct((-F.col("_points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("_raw").alias("raw"))
    salted = rows.groupBy("_digest", "_norm", "_salt").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_norm").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))

    if strong:
        key = ["_digest"]
        found = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), *(F.first(c).alias(c) for c in ("_best", "_n")))
        found = found.withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")))
    else:
        key, found = ["_digest", "_norm"], winners
    found = staged(found.select(*key, "_best", "_n"), "winners")
    # rows that are alike travel as one, with their number
    alike = rows.groupBy("doc_id", "_points", "_raw", *key).agg(F.count(F.lit(1)).alias("_rows"))
    back = meeting(alike, found, key, ["doc_id", "_raw", "_points"], hot=hot).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    best = F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("_points") == -F.col("_best.less")) & (F.col("_raw") == F.col("_best.raw"))
    sha = F.col("_digest") if strong else F.sha2(F.col("_norm"), 256)
    return back.select("doc_id", F.col("_best.id").alias("keep_id"), F.col("_n").alias("group_size"), (best & (F.col("_copy") == 1)).alias("kept"), sha.alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
