"""What a report says: inference levels, wording, completeness, invariants, and its renderings."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure a decision or a lineage relation may be said to be, and the columns of a report's table.
DECISION_INFERENCE = {
    "EXACT": "CONFIRMED_BY_RULE", "STRONG": "STRONG", "PROBABLE": "PROBABLE", "AMBIGUOUS": "AMBIGUOUS", "CONFLICT": "CONFLICTING", "UNRESOLVED": "UNRESOLVED", "ABSTAIN": "ABSTAIN",
}
RELATION_INFERENCE = {
    "RESURRECTED_CONFIRMED": "CONFIRMED_BY_RULE", "RESURRECTED_CANDIDATE": "HYPOTHESIS", "SPLIT_PARENT": "HYPOTHESIS", "MERGE_PARENT": "HYPOTHESIS", "DISAPPEARED": "NOT_OBSERVED", "UNRESOLVED": "UNRESOLVED",
}
CSV_COLUMNS = (
    "left_artifact", "left_address", "left_name", "right_artifact", "right_address", "right_name", "decision", "inference_state", "calibration_state", "strength_class", "evidence_diversity", "engine_count", "contradicting", "side",
)
PARTIAL_TITLE = "Not all evidence is there: what was not measured is unknown"


def _of(column: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def inference(decision: Column) -> Column:
    """The inference level of a matching decision; an unknown one is UNRESOLVED."""
    return F.coalesce(_of(decision, DECISION_INFERENCE), F.lit("UNRESOLVED"))


def lineage_inference(relation: Column, decision: Column) -> Column:
    """The inference level of a lineage relation: that of its decision where one carries it on, never more than the rule allows."""
    return F.when(relation.isin("CONTINUATION", "MODIFIED"), inference(decision)).otherwise(F.coalesce(_of(relation, RELATION_INFERENCE), F.lit("UNRESOLVED")))


#: What each relation of a lineage means, and what the evidence of it is made of.
MEANING = {
    "CONTINUATION": "one function in both builds, code unchanged", "MODIFIED": "one function in both builds, code changed", "RESURRECTED_CONFIRMED": "returned, under its old lineage",
    "RESURRECTED_CANDIDATE": "perhaps returned; hypothesis, two linked lineages", "SPLIT_PARENT": "perhaps part of another function before; hypothesis, two linked lineages",
    "MERGE_PARENT": "perhaps joined with others; hypothesis, linked lineages", "DISAPPEARED": "no counterpart in this build; removal is not shown", "UNRESOLVED": "origin open",
}
EVIDENCE = {"context": "callers", "data": "data", "name": "name", "rollback": "rollback event"}


def lineage_status(relation: Column, decision: Column) -> Column:
    """Relation, meaning and, where a decision carries the lineage on, the decision; an unknown relation is UNRESOLVED."""
    known = F.when(relation.isin(*MEANING), relation).otherwise("UNRESOLVED")
    by = F.when(known.isin("CONTINUATION", "MODIFIED"), F.concat(F.lit(" ["), F.coalesce(decision, F.lit("no decision")), F.lit("]"))).otherwise("")
    return F.concat(known, F.lit(" - "), _of(known, MEANING), by)


def lineage_explanation(relation: Column, code: Column, supporting: Column, reasons: Column, rejected: Column) -> Column:
    """The evidence behind a relation, as `side: items` parts; null where the relation says all. rejected: contradicting families
    of a refused return."""
    named = F.transform(supporting, lambda f: F.coalesce(_of(f, EVIDENCE), f))
    part = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", ")))
    sure = F.concat_ws("; ", part("agrees", F.concat(F.array(F.concat(F.lit("code "), code)), named)), F.lit("no contradiction, no close rival"))
    open_ = F.concat_ws("; ", F.lit("not merged"), part("for", named), part("short of confirmation", reasons))
    return F.when(relation == "RESURRECTED_CONFIRMED", sure).when(relation == "RESURRECTED_CANDIDATE", open_).when((relation == "UNRESOLVED") & rejected.isNotNull(), F.concat_ws("; ", F.lit("return refused"), part("against", rejected)))


def historical_lineage(relation: Column, lineage: Column, previous: Column, parent: Column) -> Column:
    """The lineage that an assignment points back to: its own, the one it may be, or the one it split off."""
    return F.when(relation == "RESURRECTED_CONFIRMED", lineage).when(relation == "RESURRECTED_CANDIDATE", previous).when(relation == "SPLIT_PARENT", parent)


def inspector_text(state: Column, status: Column, relation: Column, rule: Column, supporting: Column, contradicting: Column, explanation: Column) -> Column:
    """A lineage event in lines of text; hypotheses say so first."""
    names = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("nothing"))
    lines = F.array_compact(F.array(
        F.when(state == "HYPOTHESIS", "HYPOTHESIS, not established"), F.when(state == "HYPOTHESIS", ""), F.concat(F.lit("Says: "), status), F.concat(F.lit("Relation: "), relation), F.concat(F.lit("Level: "), state),
        F.concat(F.lit("Rule: "), rule), F.concat(F.lit("For it: "), names(supporting)), F.concat(F.lit("Against it: "), names(contradicting)), F.when(explanation.isNotNull(), ""), explanation,
    ))
    return F.array_join(lines, "\n")


def completeness(status: Column, n_missing: Column) -> Column:
    """struct(run_status, is_partial, title): what a report or banner says about what is missing."""
    partial = (F.coalesce(status, F.lit("UNKNOWN")) == "COMPLETED_PARTIAL") | (F.coalesce(n_missing, F.lit(0)) > 0)
    return F.struct(F.coalesce(status, F.lit("UNKNOWN")).alias("run_status"), partial.alias("is_partial"), F.when(partial, PARTIAL_TITLE).alias("title"))


def calibration_state(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows (context) with calibration_state against the contexts of one engine's validated profiles."""
    known = profiles.where("validated").select("context").distinct().withColumn("_k", F.lit(True))
    some = profiles.where("validated").limit(1).count() > 0
    return rows.join(known, "context", "left").withColumn("calibration_state", F.when(F.lit(not some), "UNCALIBRATED").when(F.col("_k"), "CALIBRATED").otherwise("OUT_OF_DISTRIBUTION")).drop("_k")


def invariant_problems(rows: DataFrame) -> DataFrame:
    """Claims that a report must not make, one row each: rows (kind, decision, relation, inference_state, status_text,
    explanation, probability) with `problem`. An empty result is a consistent report."""
    relation, state = F.col("relation"), F.col("inference_state")
    allowed = lineage_inference(relation, F.col("decision"))
    problem = F.array_compact(F.array(
        F.when((F.col("kind") == "function") & (state != inference(F.col("decision"))), "decision shown as another level"), F.when(F.col("probability").isNotNull(), "a probability is printed"),
        F.when((F.col("kind") == "event") & ~relation.isin("CONTINUATION", "MODIFIED") & (state != allowed), "relation shown as another level"),
        F.when((relation == "RESURRECTED_CANDIDATE") & ~F.lower("status_text").contains("hypothesis"), "a candidate is not called a hypothesis"),
        F.when((relation == "RESURRECTED_CONFIRMED") & ~F.coalesce(F.col("explanation"), F.lit("")).contains("agrees: "), "a confirmed return does not say why"),
    ))
    return rows.withColumn("problem", F.explode(problem))


def compared(rows: DataFrame) -> DataFrame:
    """rows (comparability, a, b) with delta: only runs that compare fully, and measured values, have one."""
    return rows.withColumn("delta", F.when((F.col("comparability") == "FULL") & F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b") - F.col("a")))


def evidence_of(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """Each match (run, left, ...) with the raw rows of all engines for its left function; null is a function too."""
    own = raw.groupBy("run", "left").agg(F.array_sort(F.collect_list(F.struct("engine", "decision", "raw_score"))).alias("raw_results"))
    own = own.select(F.col("run").alias("_run"), F.col("left").alias("_left"), "raw_results")
    return matches.join(own, (F.col("run") == F.col("_run")) & F.col("left").eqNullSafe(F.col("_left")), "left").drop("_run", "_left")


def covering_run(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The latest lineage run of a product in whose builds right follows left directly; run is null if none does.

    runs: product, run, seq, builds (array in order). pairs: product, left, right.
    """
    steps = runs.select("product", "run", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size("builds") - 1), lambda i: F.struct(F.get("builds", i - 1).alias("left"), F.get("builds", i).alias("right")))).alias("s")).where(F.size("builds") > 1)
    latest = steps.groupBy("product", "s.left", "s.right").agg(F.max_by("run", F.struct("seq", "run")).alias("run"))
    return pairs.join(latest, ["product", "left", "right"], "left")


def to_json(report: dict) -> str:
    """The report as JSON with sorted keys, as it is kept."""
    return json.dumps(report, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_csv(functions: DataFrame, path: str) -> None:
    """The function rows in the fixed columns of a report; one that is not measured is empty."""
    own = [F.col(c) if c in functions.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    functions.select(*own).orderBy("left_artifact", "left_address").write.mode("overwrite").option("header", True).csv(path)


def to_html(title: str, sections: dict[str, DataFrame], most: int) -> str:
    """Bounded tables as one page. A table with more than `most` rows says how many it has and shows the first ones."""
    cell = lambda v: html.escape("UNKNOWN" if v is None else str(v))
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.orderBy(*(F.col(c).cast("string") for c in df.columns)).limit(most + 1).collect()
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{cell(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{cell(v)}</td>' for v in r)}</tr>" for r in rows[:most]]
        out.append("</table>" + (f"<p>{df.count()} rows in all; the first {most} are shown.</p>" if len(rows) > most else ""))
    return "\n".join([*out, "</body></html>"])


def events_of(assignments: DataFrame, names: DataFrame) -> DataFrame:
    """A lineage's rows with the wording of a report: product, lineage, build, fn, name, relation, inference_state, status_text, place.

    assignments: product, lineage, build, fn, relation, decision, step; names: product, fn, name.
    """
    own = assignments.join(names, ["product", "fn"], "left")
    place = F.row_number().over(Window.partitionBy("product", "lineage").orderBy("step", "fn"))
    return own.select(
        "product", "lineage", "build", "fn", "name", "relation", lineage_inference(F.col("relation"), F.col("decision")).alias("inference_state"), lineage_status(F.col("relation"), F.col("decision")).alias("status_text"), place.alias("place")
    )


def writer(fmt: str):
    """The rendering of a name, for callers that are given one."""
    known = {"json": to_json, "csv": to_csv, "html": to_html}
    if fmt not in known:
        raise ValueError(f"no report format {fmt}")
    return known[fmt]
