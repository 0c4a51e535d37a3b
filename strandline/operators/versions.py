"""Version sequences: order, transitions, histories and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import array_median, robust_class


def ordered(versions: DataFrame, product: str, *order: Column | str, name: str = "ord") -> DataFrame:
    """Number each product's versions from 1. The order must be total for the numbers to be."""
    return versions.withColumn(name, F.row_number().over(Window.partitionBy(product).orderBy(*order)))


def transitions(versions: DataFrame, product: str, version: str, *order: Column | str) -> DataFrame:
    """Neighbouring versions as (product, left, right, step)."""
    w = Window.partitionBy(product).orderBy(*order)
    pairs = versions.select(product, F.col(version).alias("left"), F.lead(version).over(w).alias("right"), F.row_number().over(w).alias("step"))
    return pairs.where("right IS NOT NULL")


def change_ratio(versions: DataFrame, product: str, value: str, *order: Column | str) -> DataFrame:
    """Size of the relative change since the version before, null for a first version."""
    before = F.lag(value).over(Window.partitionBy(product).orderBy(*order))
    return versions.withColumn("metric", F.abs((F.col(value) - before) / F.nullif(before, F.lit(0.0))))


def with_baseline(measured: DataFrame, series: str, *order: Column | str, value: str = "metric") -> DataFrame:
    """Class of each value against all earlier values of its series.

    One window gathers the history: its own value is not in it, so appending after classifying, one
    version at a time, gives the same rows. A series is one product's versions, which bounds the array.
    """
    w = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = measured.withColumn("_history", F.collect_list(value).over(w)).withColumn("_median", array_median(F.col("_history")))
    out = out.withColumn("_mad", array_median(F.transform("_history", lambda x: F.abs(x - F.col("_median")))))
    out = out.withColumn("n_history", F.size("_history")).withColumn("class", robust_class(F.col(value), F.col("_history"), F.col("_median"), F.col("_mad")))
    return out.drop("_history", "_median", "_mad")


def latest(rows: DataFrame, scope: list[str], *order: Column | str) -> DataFrame:
    """The first row of each scope in the given order."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def duplicate_ordinals(entries: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Number equal entries from 0, so that a multiset can be told by its set of rows."""
    return entries.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def fingerprint(entries: DataFrame, version: str, fields: list[str]) -> DataFrame:
    """A digest of a version's entries that does not depend on their order."""
    line = F.concat_ws("\t", *(F.col(f).cast("string") for f in fields))
    return entries.groupBy(version).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_entries"))


def last_two(rows: DataFrame, source: str, version: str, *order: Column | str) -> DataFrame:
    """The last version of each source beside the one before; sources with fewer than two have no row."""
    w = Window.partitionBy(source).orderBy(*order)
    out = rows.select(source, F.col(version).alias("right"), F.lag(version).over(w).alias("left"), F.lead(version).over(w).alias("_next"))
    return out.where("_next IS NULL AND left IS NOT NULL").select(source, "left", "right")


def stable(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Copies (key, sha256) whose digest was the same in two reads; all others are not taken yet."""
    return first.join(second.select(*key, "sha256"), [*key, "sha256"], "left_semi")


def folder_fingerprint(entries: DataFrame, folder: str, name: str = "name", sha: str = "sha256") -> DataFrame:
    """A digest of a watched folder: its names in lower case with their digests, in the order of the names."""
    own = entries.groupBy(folder).agg(F.array_sort(F.collect_list(F.struct(F.lower(name).alias("n"), F.col(sha).alias("s")))).alias("_e"))
    return own.select(folder, F.sha2(F.array_join(F.transform("_e", lambda e: F.concat_ws("\t", e["n"], e["s"])), "\n"), 256).alias("fingerprint"))
