"""Change dimensions of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimensions(transitions: DataFrame, keys: list[Column], metrics: dict[str, Column]) -> DataFrame:
    """One row per transition and dimension: state and metric. A null metric is NOT_MEASURED.

    All dimensions come from one pass over the transitions; there is no score over them.
    """
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), m.cast("long").alias("metric")) for d, m in metrics.items()))
    out = transitions.select(*keys, F.explode(rows).alias("_d")).select("*", "_d.dimension", "_d.metric").drop("_d")
    return out.withColumn("state", F.when(F.col("metric").isNull(), "NOT_MEASURED").otherwise("MEASURED"))


def structural(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Per component: left functions, unresolved ones, modified ones and the growth of matched ones.

    left: left, l_size; right: right, r_size. Only STRONG and PROBABLE pairs can be modified.
    """
    own = matches.join(left, "left", "left").join(right, "right", "left")
    matched = F.col("decision").isin("STRONG", "PROBABLE")
    return own.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_left"), F.count_if(F.col("decision") == "UNRESOLVED").alias("unresolved_left"), F.count_if(matched & (F.col("l_size") != F.col("r_size"))).alias("modified"),
        F.coalesce(F.sum(F.when(matched, F.col("r_size") - F.col("l_size"))), F.lit(0)).cast("long").alias("size_delta"),
    )


def reliability_level(coverage: Column, missing: Column, extraction: Column, unverified: Column) -> Column:
    """How far a comparison can be relied on.

    LOW where run coverage is under 0.6 or extraction under a half; MEDIUM where evidence is missing,
    extraction under 0.9 or an engine unverified; else HIGH. extraction: the least share of code that
    either side's functions cover. What is unknown lowers nothing.
    """
    low = F.coalesce(coverage < 0.6, F.lit(False)) | F.coalesce(extraction < 0.5, F.lit(False))
    medium = (F.coalesce(missing, F.lit(0)) > 0) | F.coalesce(extraction < 0.9, F.lit(False)) | (F.coalesce(unverified, F.lit(0)) > 0)
    return F.when(low, "LOW").when(medium, "MEDIUM").otherwise("HIGH")


def _only(a: Column, b: Column) -> Column:
    """What is in a and not in b, sorted; null where either was not measured."""
    return F.when(a.isNotNull() & b.isNotNull(), F.array_sort(F.array_except(a, b)))


def binary(l: Column, r: Column, near: Column | None = None) -> Column:  # noqa: E741
    """struct(state, size_delta_ratio, sections_added, sections_removed, sections_changed, resources_changed).

    Of structs with size, sections (map name -> digest) and resources (digests). Without the sections of
    both sides the dimension is PARTIAL. near: the distance of the fuzzy digests of both, if they were taken;
    it becomes a further field, fuzzy_distance.
    """
    names, other = F.map_keys(l["sections"]), F.map_keys(r["sections"])
    both = F.filter(F.array_intersect(names, other), lambda n: F.element_at(l["sections"], n) != F.element_at(r["sections"], n))
    there = l["sections"].isNotNull() & r["sections"].isNotNull()
    ratio = (r["size"] - l["size"]) / F.greatest(F.lit(1), l["size"])
    changed = F.size(F.array_except(l["resources"], r["resources"])) + F.size(F.array_except(r["resources"], l["resources"]))
    return F.struct(
        F.when(there, "MEASURED").otherwise("PARTIAL").alias("state"), ratio.alias("size_delta_ratio"), _only(other, names).alias("sections_added"), _only(names, other).alias("sections_removed"), F.array_sort(both).alias("sections_changed"),
        F.when(l["resources"].isNotNull() & r["resources"].isNotNull(), changed).alias("resources_changed"), *([] if near is None else [near.alias("fuzzy_distance")]),
    )


def build(l: Column, r: Column) -> Column:  # noqa: E741
    """struct(state, ..._changed): how the sides were built. Of structs with image, linker, timestamp, rich, signed, signer, pdb.

    A hint that neither side has, and a signer that not both have, is unknown, not unchanged.
    """
    there = F.coalesce(l["image"] & r["image"], F.lit(False))
    differ = lambda f: ~l[f].eqNullSafe(r[f])
    either = lambda f: l[f].isNotNull() | r[f].isNotNull()
    signed = lambda s: F.coalesce(s["signed"], F.lit(False))
    own = {
        "linker_version_changed": differ("linker"), "timestamp_changed": differ("timestamp"), "toolchain_hint_changed": F.when(either("rich"), differ("rich")),
        "signature_presence_changed": signed(l) != signed(r), "signer_changed": F.when(signed(l) & signed(r), differ("signer")), "pdb_changed": F.when(either("pdb"), differ("pdb")),
    }
    return F.struct(F.when(there, "MEASURED").otherwise("UNSUPPORTED").alias("state"), *(F.when(there, v).alias(k) for k, v in own.items()))


def semantic(l: Column, r: Column) -> Column:  # noqa: E741
    """struct(state, imports, exports, strings added and removed). Of structs with imports, exports and strings as sets;
    without the imports of both sides the dimension is PARTIAL."""
    there = l["imports"].isNotNull() & r["imports"].isNotNull()
    n = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.size(F.array_except(a, b)))
    return F.struct(
        F.when(there, "MEASURED").otherwise("PARTIAL").alias("state"), _only(r["imports"], l["imports"]).alias("imports_added"), _only(l["imports"], r["imports"]).alias("imports_removed"),
        _only(r["exports"], l["exports"]).alias("exports_added"), _only(l["exports"], r["exports"]).alias("exports_removed"), n(r["strings"], l["strings"]).alias("strings_added"), n(l["strings"], r["strings"]).alias("strings_removed"),
    )


def deployment(left_first: Column, right_first: Column, n_left: Column, n_right: Column) -> Column:
    """struct(state, gap_days, observations): days between the first observations; PARTIAL if a date is none."""
    gap = F.datediff(right_first, left_first)
    seen = (n_left > 0) & (n_right > 0)
    return F.struct(F.when(~seen, "NOT_MEASURED").when(gap.isNull(), "PARTIAL").otherwise("MEASURED").alias("state"), F.when(seen, gap).alias("gap_days"), n_left.alias("observations_left"), n_right.alias("observations_right"))


def modified(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Per component: functions, unresolved on both sides, modified ones with ratio and growth of their cyclomatic number.

    matches: component, left, right, decision, side ('right-only' for rows of unmatched right functions).
    left and right: component, address, hash, cyclomatic. STRONG and PROBABLE pairs whose hashes differ
    are modified; a right function counts once.
    """
    side = lambda f, n: f.select("component", F.col("address").alias(n), F.col("hash").alias(f"{n}_hash"), F.col("cyclomatic").alias(f"{n}_cyclomatic"))
    pairs = matches.where(F.col("decision").isin("STRONG", "PROBABLE")).join(side(left, "left"), ["component", "left"]).join(side(right, "right"), ["component", "right"])
    pairs = pairs.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    own = pairs.groupBy("component").agg(F.countDistinct("right").alias("modified_functions"), F.sum(F.col("right_cyclomatic") - F.col("left_cyclomatic")).alias("cyclomatic_delta_sum"))
    only = F.coalesce(F.col("side") == "right-only", F.lit(False))
    counts = matches.groupBy("component").agg(F.count_if(~only & (F.col("decision") == "UNRESOLVED")).alias("unresolved_left"), F.count_if(only).alias("unresolved_right"))
    total = lambda f, n: f.groupBy("component").agg(F.count(F.lit(1)).alias(n))
    out = counts.join(total(left, "functions_left"), "component", "left").join(total(right, "functions_right"), "component", "left").join(own, "component", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ratio = F.try_divide(F.coalesce("modified_functions", F.lit(0)), F.nullif("functions_left", F.lit(0)))
    return out.select("component", zero("functions_left"), zero("functions_right"), "unresolved_left", "unresolved_right", zero("modified_functions"), zero("cyclomatic_delta_sum"), ratio.alias("modified_ratio"))


def change_rows(pairs: DataFrame, keys: list[str], dims: dict[str, tuple[Column, Column]], reliability: Column) -> DataFrame:
    """The seven rows of each component pair: dimension, state, metrics as JSON, reliability. dims: name -> (state, struct of metrics).

    Dimensions stay apart: there is no score over them. Metrics are made after the rows are, so that what only they need
    is not read, shuffled or kept where they are not asked for.
    """
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), state.alias("state")) for d, (state, _) in dims.items()))
    out = pairs.withColumns({"reliability": reliability, "_d": F.explode(rows)})
    metrics = F.coalesce(*(F.when(F.col("_d.dimension") == d, F.to_json(m)) for d, (_, m) in dims.items()))
    return out.select(*keys, "_d.dimension", "_d.state", metrics.alias("metrics"), "reliability")


def undetected(runs: DataFrame, detected: DataFrame, run: str) -> DataFrame:
    """Runs whose changes were not written yet: results are immutable, so a run is reported once."""
    return runs.join(detected.select(run).distinct(), run, "left_anti")
