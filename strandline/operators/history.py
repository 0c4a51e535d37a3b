"""A product's history that grows build by build: functions, matches and lineages in one store.

Every call adds builds in one commit, with the comparisons that they make possible and the lineages that
follow. What an earlier call has folded is carried forward as long as the builds it folded are still the
first ones of the product, with the same functions, matches and rollbacks; a product whose beginning
has changed is folded anew, and no other. What a call needs only for itself is deleted at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import comparison, lineage
from .commits import Store, Version
from .graph import _kept, scratch

RUN = ("assignments", "links", "current", "placed", "lost")
BUILDS = "product string, build string, at string"


def ordered(builds: DataFrame) -> DataFrame:
    """builds (product, build, at) with ord: by time of observation, unknown last, then by name."""
    w = Window.partitionBy("product").orderBy(F.col("at").asc_nulls_last(), "build")
    return builds.select("product", "build", F.row_number().over(w).alias("ord"))


def contents(builds: DataFrame, functions: DataFrame, matches: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """product, ord, digest of what each build brings: its functions, its matches with the build before, its rollbacks.

    functions and matches as the fold takes them. Digests do not depend on the order of rows.
    """

    def summed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("product", "build").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))).alias(name))

    before = F.lag("build").over(Window.partitionBy("product").orderBy("ord"))
    out = builds.withColumn("left_build", before)
    sums = {"_f": functions, "_m": matches.join(out.select("product", "left_build", F.col("build").alias("right_build")), ["product", "left_build", "right_build"], "left_semi").withColumnRenamed("right_build", "build")}
    if rollbacks is not None:
        sums["_r"] = rollbacks.select("product", "build").distinct()
    for name, df in sums.items():
        out = out.join(summed(df, name), ["product", "build"], "left")
    return out.select("product", "ord", F.sha2(F.to_json(F.struct("build", *sums), {"ignoreNullFields": "false"}), 256).alias("digest"))


def prefixes(digests: DataFrame, lengths: DataFrame) -> DataFrame:
    """product, n, digest of the first n builds, for lengths (product, n)."""
    own = digests.join(lengths, "product").where("ord <= n").groupBy("product", "n")
    return own.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ord", "digest")))), 256).alias("digest"))  # a short row for each build


def extend(store: Store, batch: str, builds: DataFrame, functions: DataFrame, matches: DataFrame, rollbacks: DataFrame | None = None, append: dict | None = None) -> Version:
    """Fold what is new and commit the lineages with it, under the name of the batch.

    builds: product, build, ord; functions, matches and rollbacks as lineage.run takes them, for all builds. append:
    other tables' rows that become visible in the same commit. A batch that was committed is not folded again.
    """
    found = store.find(batch)
    if found is not None:
        return found
    with scratch(store.spark):
        base = store.version()
        digests = _kept(contents(builds, functions, matches, rollbacks))
        before = done = None
        if base is not None and "folded" in base.tables:
            had = store.read("folded", base.number)
            same = prefixes(digests, had.select("product", "n")).join(had, ["product", "n", "digest"])
            done = _kept(same.select("product", "n"))
            only = lambda t: store.read(t, base.number).join(done, "product", "left_semi")
            before = lineage.Run(*map(only, RUN))
        run = lineage.run(builds, functions, matches, rollbacks, before, done)
        lengths = builds.groupBy("product").agg(F.max("ord").cast("int").alias("n"))
        tables = {name: getattr(run, name) for name in RUN}
        since = lengths.limit(0) if done is None else done
        status = F.when(F.col("step") < F.col("n"), "CARRIED_FORWARD").otherwise("ASSIGNED")
        tables["assignments"] = run.assignments.join(since, "product", "left").withColumn("status", F.coalesce(status, F.lit("ASSIGNED"))).drop("n")
        tables["folded"] = prefixes(digests, lengths).select("product", "n", "digest")
        return store.commit(batch, tables, append, after=base.number if base else None)


def add(store: Store, batch: str, builds: DataFrame, functions: DataFrame, rollbacks: DataFrame | None = None) -> Version:
    """Add builds (product, build, at) with their functions (as comparison.compare takes them), compare what became
    neighbours, and extend the lineages: one commit. A build that the store has is left as it is."""
    found = store.find(batch)
    if found is not None:
        return found
    with scratch(store.spark):
        old = store.tables()
        if "builds" in old:
            known = store.read("builds").select("product", "build")
            builds, functions = builds.join(known, ["product", "build"], "left_anti"), functions.join(known, ["product", "build"], "left_anti")
        builds = _kept(builds.dropDuplicates(["product", "build"]))
        functions = _kept(functions.join(builds.select("product", "build"), ["product", "build"], "left_semi"))
        all_builds = builds.unionByName(store.read("builds")) if "builds" in old else builds
        all_functions = functions.unionByName(store.read("functions")) if "functions" in old else functions
        all_builds = _kept(ordered(all_builds))
        steps = comparison.transitions(all_builds)
        if "compared" in old:
            steps = steps.join(store.read("compared").select("product", "left_build", "right_build"), ["product", "left_build", "right_build"], "left_anti")
        steps = _kept(steps)
        c = comparison.compare(all_functions, steps)
        rows = _kept(comparison.lineage_rows(c))
        matches = rows.unionByName(store.read("matches")) if "matches" in old else rows
        new = {"builds": builds, "functions": functions, "compared": steps, "matches": rows}
        return extend(store, batch, all_builds, comparison.as_lineage(all_functions), matches, rollbacks, append=new)
