"""Retention: log budgets, backup schedules, purge plans, reconciliation and job order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def over_budget(files: DataFrame, group: str, at: str, size: str, budget: float, *tie: str) -> DataFrame:
    """Newest first, mark the files that bring their group's running total over the budget."""
    w = Window.partitionBy(group).orderBy(F.desc(at), *tie).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("running", F.sum(size).over(w)).withColumn("expired", F.col("running") > budget)


def backups_to_keep(backups: DataFrame, group: str, at: str, tie: str, newest: int = 7, weeks: int = 4) -> DataFrame:
    """Keep the newest seven, and the newest of each of the latest four ISO weeks."""
    week = F.date_format(F.date_trunc("week", F.col(at)), "yyyy-MM-dd")
    own = backups.withColumn("week", week)
    order = [F.desc(at), F.desc(tie)]
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    own = own.withColumn("_w", F.row_number().over(Window.partitionBy(group, "week").orderBy(*order)))
    own = own.withColumn("_k", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("week"))))
    return own.withColumn("kept", (F.col("_n") <= newest) | ((F.col("_w") == 1) & (F.col("_k") <= weeks))).drop("_n", "_w", "_k")


def purge_plan(uses: DataFrame, owner: str, artifact: str) -> DataFrame:
    """Artifacts of each owner: EXCLUSIVE if no other owner uses them, else SHARED."""
    pairs = uses.select(owner, artifact).distinct()
    owners = pairs.groupBy(artifact).agg(F.count(F.lit(1)).alias("n_owners"))
    return pairs.join(owners, artifact).withColumn("plan", F.when(F.col("n_owners") == 1, "EXCLUSIVE").otherwise("SHARED"))


def reconciled(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys by where they are: stored and known (OK), stored only (ORPHAN), known only (MISSING)."""
    a, b = stored.select(key).distinct().withColumn("_s", F.lit(1)), known.select(key).distinct().withColumn("_k", F.lit(1))
    state = F.when(F.col("_s").isNull(), "MISSING").when(F.col("_k").isNull(), "ORPHAN").otherwise("OK")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def next_jobs(jobs: DataFrame, queue: str, priority: str, created: str, seq: str, now) -> DataFrame:
    """Each queue's next job: priority plus a point for each full minute of age, then the oldest."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 60)
    aged = jobs.withColumn("effective", F.col(priority) + age)
    best = F.row_number().over(Window.partitionBy(queue).orderBy(F.desc("effective"), seq))
    return aged.withColumn("_n", best).where("_n = 1").drop("_n")


def cleanup_plan(files: DataFrame, active: DataFrame, now, temp_days: int = 1, quarantine_days: int = 30, log_budget: float = 1e9) -> DataFrame:
    """What may be removed: path, category, bytes, reason. files: root, category, name, at, bytes, state.

    Temporary files older than some days (unless a run is at work on them, active: name; names in .tmp at
    once), logs beyond the budget, backups outside the schedule, old quarantine, results that failed.
    Sources and current results are in no category, so never in the plan.
    """
    age = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400
    of = lambda c: files.where(F.col("category") == c)
    temp = of("temp").join(active.select("name").distinct(), "name", "left_anti").where(F.col("name").endswith(".tmp") | (age >= temp_days))
    logs = over_budget(of("logs"), "root", "at", "bytes", log_budget, "name").where("expired").drop("running", "expired")
    backups = backups_to_keep(of("backups"), "root", "at", "name").where("NOT kept").drop("week", "kept")
    parts = {"temporary": temp, "beyond the log budget": logs, "outside the schedule": backups, "old quarantine": of("quarantine").where(age >= quarantine_days), "failed result": of("cache").where(F.col("state").isin("FAILED", "CORRUPTED"))}
    out = None
    for reason, rows in parts.items():
        one = rows.select("root", "category", "name", "bytes", F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def quarantined(reconciled_: DataFrame) -> DataFrame:
    """State rows for what is stored and not known: QUARANTINED; nothing is deleted."""
    return reconciled_.where("state = 'ORPHAN'").withColumn("state", F.lit("QUARANTINED"))
