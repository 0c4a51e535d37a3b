"""State kept as append-only rows: sequences, current views, inserts that ignore what is known, checks.

Nothing here updates in place. A table's present state is the latest row of each key, a deletion is a
row with a tombstone, and a batch becomes visible by the rows that name it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _kept
from .versions import latest


def numbered(rows: DataFrame, *order: str, start: int = 0, name: str = "seq") -> DataFrame:
    """Number rows from start + 1 in the given order, which should be total.

    Rows are dealt to ranges of the order; a range's first number is the count of all ranges before
    it, so no task sees all rows.
    """
    dealt = _kept(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # a row for each range
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_n", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_n") + F.col("_before") + start).drop("_p", "_n", "_before")


def current(rows: DataFrame, key: list[str], *order: Column | str, deleted: str | None = None) -> DataFrame:
    """The latest row of each key; with `deleted`, only those whose tombstone is null."""
    out = latest(rows, key, *order)
    return out if deleted is None else out.where(F.col(deleted).isNull())


def _lacking(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key is not among those of existing; null is a value."""
    known = existing.select(*(F.col(k).alias(f"_k_{k}") for k in key)).distinct()
    return rows.join(known, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key)), "left_anti")


def insert_new(existing: DataFrame, rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The rows to append: of each key that does not exist yet, the first in the given order. Null is a value of a key."""
    return latest(_lacking(rows, existing, key), key, *order)


def get_or_create(existing: DataFrame, rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Distinct keys of rows with their id: the one that exists, else one made from the key; and `created`."""
    own = rows.select(*key).distinct()
    known = existing.groupBy(*(F.col(k).alias(f"_k_{k}") for k in key)).agg(F.min(id_col).alias("_id"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key))
    made = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    return own.join(known, same, "left").select(*key, F.coalesce("_id", made).alias(id_col), F.col("_id").isNull().alias("created"))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `problems`: the names of the rules that do not hold, in their order. A null rule does not hold."""
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))))


def import_plan(files: DataFrame, batch: str, order: list[str], role: str, artifact: str, overrides: DataFrame | None = None) -> DataFrame:
    """What each batch of files would bring: new artifacts, known ones, and whether an earlier batch is the same build.

    A file's role may be overridden by (artifact, override). An artifact is new in the first batch that
    has it. Builds are the same if their multisets of (role, artifact) are.
    """
    own = files.select(batch, *order, F.col(role).alias("_role"), F.col(artifact).alias("_artifact"))
    if overrides is not None:
        own = own.join(overrides.select(F.col(artifact).alias("_artifact"), "override"), "_artifact", "left").withColumn("_role", F.coalesce("override", "_role")).drop("override")
    place = F.struct(*order, batch)
    first = own.groupBy("_artifact").agg(F.min(place).alias("_first"))
    seen = own.join(first, "_artifact").groupBy(batch, *order).agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("_artifact").alias("n_artifacts"), F.countDistinct(F.when(F.col("_first") == place, F.col("_artifact"))).alias("n_new"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "_role", F.col("_artifact").cast("string")))), "\n"), 256).alias("fingerprint"),
    )
    earlier = seen.groupBy("fingerprint").agg(F.min(place).alias("_build"))
    return seen.join(earlier, "fingerprint").withColumn("duplicate_of", F.when(F.col("_build") != place, F.col(f"_build.{batch}"))).drop("_build")


def integrity(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """State of each stored row (key, sha256) against what was read (key, digest): AVAILABLE, CORRUPTED or MISSING."""
    state = F.when(F.col("digest").isNull(), "MISSING").when(F.col("digest") == F.col("sha256"), "AVAILABLE").otherwise("CORRUPTED")
    return stored.join(found.select(key, "digest"), key, "left").select(key, state.alias("state"))


def refused(wanted: DataFrame, states: DataFrame, group: str, key: str) -> DataFrame:
    """Groups (builds) that must not be analysed: those with an artifact that is not AVAILABLE, and how many."""
    bad = states.where("state <> 'AVAILABLE'").select(key)
    return wanted.join(bad, key, "left_semi").groupBy(group).agg(F.countDistinct(key).alias("n_bad"))


def derived_for(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per (processor, artifact): the result that counts, directly derived or one hop away.

    results: result, processor, state, created. inputs: result, kind ('artifact' or 'derived'), ref.
    A direct result wins over one by a hop, CURRENT over others, then the newest, then the largest id.
    """
    usable = results.where(F.col("state").isin("CURRENT", "STALE"))
    direct = inputs.where("kind = 'artifact'").select("result", F.col("ref").alias("artifact"))
    hop = inputs.where("kind = 'derived'").select("result", F.col("ref").alias("_via")).join(direct.withColumnRenamed("result", "_via"), "_via").select("result", "artifact")
    both = direct.withColumn("hops", F.lit(0)).unionByName(hop.withColumn("hops", F.lit(1))).distinct()
    rows = usable.join(both, "result")
    return latest(rows, ["processor", "artifact"], "hops", F.desc(F.col("state") == "CURRENT"), F.desc("created"), F.desc("result")).select("processor", "artifact", "result", "state", "hops")


def found_by(products: DataFrame, refs: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Each reference (ref) with the product that it names: by id, else by a name that only one has; else null."""
    by_id = products.select(F.col(id_col).cast("string").alias("ref"), F.col(id_col).alias("_by_id"))
    by_name = products.groupBy(F.col(name_col).alias("ref")).agg(F.count(F.lit(1)).alias("_c"), F.min(id_col).alias("_by_name")).where("_c = 1")
    return refs.join(by_id, "ref", "left").join(by_name, "ref", "left").select("ref", F.coalesce("_by_id", "_by_name").alias(id_col))


def settings(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Every known key with its latest stored value, or its default. stored: key, value, seq; defaults: key, default."""
    last = current(stored, ["key"], F.desc("seq")).select("key", "value")
    return defaults.join(last, "key", "left").select("key", F.coalesce("value", "default").alias("value"), F.col("value").isNotNull().alias("changed"))


def accepted_settings(writes: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """writes (key, value, seq, mode) with `accepted`: a write from a mode of a lower rank than the highest so far is not."""
    rank = F.coalesce(*(F.when(F.col("mode") == m, r) for m, r in ranks.items()), F.lit(-1))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = writes.withColumn("_r", rank)
    return out.withColumn("accepted", F.col("_r") >= F.coalesce(F.max("_r").over(before), F.lit(-1))).drop("_r")


def merged_tables(existing: DataFrame, pack: DataFrame, key: list[str], has_bytes: Column) -> DataFrame:
    """Rows of a pack that are new, with the state in which they come: AVAILABLE with their bytes, else METADATA_ONLY."""
    return _lacking(pack, existing, key).withColumn("integrity_state", F.when(has_bytes, "AVAILABLE").otherwise("METADATA_ONLY"))


def purge(plan: DataFrame, busy: DataFrame, artifact: str) -> DataFrame:
    """A purge plan (plan: EXCLUSIVE or SHARED) with what jobs are at work on kept: IN_USE."""
    held = busy.select(artifact).distinct().withColumn("_busy", F.lit(True))
    return plan.join(held, artifact, "left").withColumn("plan", F.when(F.col("_busy"), "IN_USE").otherwise(F.col("plan"))).drop("_busy")


def with_ids(pairs: DataFrame, functions: DataFrame, scope: str = "artifact") -> DataFrame:
    """Matcher pairs (left_artifact, left, right_artifact, right) with the ids of their functions, null where there is none.

    functions: scope, address, id, created; of several rows for an address the last one counts.
    """
    last = latest(functions, [scope, "address"], F.desc("created"), F.desc("id"))
    side = lambda n: last.select(F.col(scope).alias(f"{n}_artifact"), F.col("address").alias(n), F.col("id").alias(f"{n}_id"))
    return pairs.join(side("left"), ["left_artifact", "left"], "left").join(side("right"), ["right_artifact", "right"], "left")


def reproducible(runs: DataFrame, packs: DataFrame, installed: DataFrame) -> DataFrame:
    """Each run with a pack (run, pack): whether the very pack that it used is installed (pack, manifest)."""
    used = runs.join(packs.select("pack", F.col("manifest").alias("_used")), "pack")
    there = used.join(installed.select("pack", F.col("manifest").alias("_there")), "pack", "left")
    return there.select("run", "pack", F.coalesce(F.col("_used") == F.col("_there"), F.lit(False)).alias("reproducible"))


def members_checked(members: DataFrame, archive: str, most: int, most_bytes: int, most_total: int, most_ratio: int) -> DataFrame:
    """Members of archives (archive, place, name, bytes, packed, encrypted, link) with `problem`: null for a safe one.

    Names must stay inside the archive and differ in more than case; sizes are bounded one by one, by
    what they unpack to, and in all, in the order of the members.
    """
    so_far = Window.partitionBy(archive).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    again = F.row_number().over(Window.partitionBy(archive, F.lower("name")).orderBy("place")) > 1
    out = members.withColumn("_again", again).withColumn("_total", F.sum("bytes").over(so_far)).withColumn("_n", F.row_number().over(Window.partitionBy(archive).orderBy("place")))
    outside = F.col("name").startswith("/") | F.col("name").contains("\\") | F.col("name").rlike("^[A-Za-z]:") | F.array_contains(F.split("name", "/"), "..") | (F.col("name") == "")
    problem = (
        F.when(outside, "path").when(F.col("encrypted"), "encrypted").when(F.col("link"), "link").when(F.col("_again"), "duplicate").when(F.col("bytes") > most_bytes, "size")
        .when(F.col("bytes") > F.greatest(F.col("packed"), F.lit(1)) * most_ratio, "ratio").when(F.col("_total") > most_total, "total").when(F.col("_n") > most, "count")
    )
    return out.withColumn("problem", problem).drop("_again", "_total", "_n")
