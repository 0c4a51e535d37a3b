"""Search over names, hashes and annotation text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Scratch


def hash_prefix(column: Column, prefix: str) -> Column:
    """The range predicate of a hexadecimal prefix; Parquet statistics can prune by it."""
    return (column >= prefix) & (column < prefix + "g")


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive containment, without wildcards."""
    return F.lower(column).contains(needle.lower())


def tokens(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(query: str) -> list[str]:
    """The first eight words of a query, each once, in lower case."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()[:8]))


def has_tokens(text: Column, query: str) -> Column:
    """All of at most eight words of the query stand in the text; a query without words finds nothing.

    Each word is looked for between characters that are no letters or digits, up to its first place.
    """
    wanted = query_words(query)
    own = F.lower(text)
    return reduce(lambda a, b: a & b, (own.rlike(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])") for w in wanted), F.lit(bool(wanted)))


def find(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that have all words of the query, from a token table (key, token, n), the rarest word first.

    Only the words' own rows are read; each further word can only take keys away.
    """
    wanted = query_words(query)
    counts = {r["token"]: r["count"] for r in index.where(F.col("token").isin(wanted)).groupBy("token").count().collect()}  # eight rows at most
    if not wanted or len(counts) < len(wanted):
        return index.select(key).limit(0)
    rows = [index.where(F.col("token") == w).select(key) for w in sorted(wanted, key=lambda w: (counts[w], w))]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), rows)


def merged(parts: list[DataFrame], limit: int) -> DataFrame:
    """Hits (kind, id, label) of several searches: the first search that has a (kind, id) counts."""
    ranked = reduce(DataFrame.unionByName, (p.select("kind", "id", "label", F.lit(k).alias("rank")) for k, p in enumerate(parts)))
    first = F.row_number().over(Window.partitionBy("kind", "id").orderBy("rank", "label"))
    return ranked.withColumn("_n", first).where("_n = 1").orderBy("rank", "kind", "id").limit(limit).drop("_n")


def index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The token table of a text column, made anew: key, token, how often."""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def stored_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The token table written in the shared folder, sorted by token in each file, so that a word's rows are few row groups."""
    return Scratch(rows.sparkSession).keep(index(rows, key, text).repartition("token").sortWithinPartitions("token", key))
