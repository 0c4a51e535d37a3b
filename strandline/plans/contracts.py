"""Schemas, bounds and redaction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: An event as a document: a closed object whose measurements are bounded.
EVENT = {
    "$defs": {"props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}}, "additionalProperties": False}},
    "type": "object", "required": ["type", "user"],
    "properties": {"type": {"enum": ["view", "click", "purchase"]}, "user": {"type": "integer"}, "value": {"type": ["number", "null"], "maximum": 90}, "props": {"$ref": "#/$defs/props"}, "tags": {"type": "array", "maxItems": 2, "uniqueItems": True, "items": {"type": "string", "maxLength": 4}}},
    "additionalProperties": False,
}


@query("""
WITH e AS (SELECT event_id, event_type AS t, user_id % 7 = 0 AS no_user, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 5 = 0 AS more, event_id % 3 AS n_tags, event_id % 11 = 0 AS odd FROM events),
 p AS (SELECT event_id, [CASE WHEN t NOT IN ('view', 'click', 'purchase') THEN '$.type: not in enum' END, CASE WHEN no_user THEN '$: missing user' END, CASE WHEN value > 90 THEN '$.value: above maximum' END,
  CASE WHEN k < 5 THEN '$.props.k: below minimum' END, CASE WHEN k > 90 THEN '$.props.k: above maximum' END, CASE WHEN more THEN '$.props: unexpected more' END,
  CASE WHEN n_tags = 2 THEN '$.tags: items not unique' END, CASE WHEN n_tags >= 1 AND length(t) > 4 THEN '$.tags[0]: longer than maxLength' END, CASE WHEN n_tags = 2 AND length(t) > 4 THEN '$.tags[1]: longer than maxLength' END,
  CASE WHEN odd THEN '$: unexpected odd' END] AS x FROM e)
SELECT event_id, problem FROM (SELECT event_id, unnest(x) AS problem FROM p) WHERE problem IS NOT NULL
""")
def contract_problems(spark, sf_dir):
    """Every way in which events, as documents, break their schema."""
    i = F.col("event_id")
    props = F.parse_json(F.when(i % 5 == 0, F.regexp_replace("props", r"\}$", ', "more": 1}')).otherwise(F.col("props")))
    doc = F.struct(
        F.col("event_type").alias("type"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user"), F.col("value"), props.alias("props"), F.array_repeat(F.col("event_type"), (i % 3).cast("int")).alias("tags"), F.when(i % 11 == 0, 1).alias("odd"),
    )
    text = F.to_json(doc)  # fields that are null are left out
    found = contracts.problems(F.parse_json(text), EVENT)
    return table(spark, sf_dir, "events").select("event_id", F.explode(found).alias("problem"))


@query(r"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' ' || role || conv_id || '@example.org 10.0.0.' || (conv_id % 200), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '<mail>', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '<address>', 'g'), '[0-9a-f]{32,}', '<hex>', 'g'), '[0-9]{9,}', '<number>', 'g') AS said FROM conversations)
SELECT conv_id, count(*) AS n, sha256(string_agg(said, chr(10) ORDER BY turn, role, said)) AS said_sha256, '<mail>' AS owner FROM c GROUP BY conv_id
""")
def redacted_turns(spark, sf_dir):
    """Conversations as nested rows, with every string in them cleaned before any is written out."""
    turns = table(spark, sf_dir, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("role"), F.col("conv_id"), F.lit("@example.org 10.0.0."), F.col("conv_id") % 200)
    row = F.struct("turn", "role", F.map_from_arrays(F.array(F.lit("said")), F.array(said)).alias("parts"))
    nested = turns.groupBy("conv_id").agg(F.collect_list(row).alias("turns"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("@example.org")).alias("owner"))
    kinds = nested.schema
    clean = nested.select("conv_id", *(contracts.redacted(F.col(c), kinds[c].dataType).alias(c) for c in ("turns", "owner")))
    lines = F.transform(F.array_sort(F.transform("turns", lambda t: F.struct(t["turn"], t["role"], t["parts"]["said"].alias("said")))), lambda t: t["said"])
    return clean.select("conv_id", F.size("turns").cast("long").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("said_sha256"), "owner")
