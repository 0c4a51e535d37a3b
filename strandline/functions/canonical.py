"""Canonical forms: JSON that hashes alike, cache keys, names, versions, orders and guarded values."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a file name must not have; fixed by the file systems that names are kept for.
UNSAFE = r'[<>:"/\\|?*\x00-\x1F]'


def canonical(value, floats: bool = False) -> str:
    """JSON with sorted keys, no white space and strings in Unicode's composed form. Floats are refused
    unless asked for: an identity must not depend on how a number is written."""

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, int):
            return x
        if isinstance(x, float):
            if not floats or x != x or abs(x) == float("inf"):
                raise TypeError("a float has no canonical form here")
            return x
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            out = {plain(str_key(k)): plain(v) for k, v in x.items()}
            if len(out) < len(x):
                raise TypeError("two keys that are one in composed form")
            return out
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        raise TypeError(f"no canonical form of {type(x).__name__}")

    def str_key(k):
        if not isinstance(k, str):
            raise TypeError("a key that is no string")
        return k

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: Column, floats: bool = True) -> Column:
    """The canonical form of JSON texts; null for null and for what is no JSON or has no such form."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else canonical(json.loads(t), floats)
            except (ValueError, TypeError):
                return None

        return texts.map(one)

    return run(text)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def cache_key(processor: Column, version: Column, inputs: Column, config: Column, schema: Column) -> Column:
    """SHA-256 of the canonical JSON array of what a result depends on; the order of inputs (an array of hashes) counts.

    Processor and version are names without quotes or control characters."""
    array = F.concat(F.lit("["), F.array_join(F.transform(inputs, _quoted), ","), F.lit("]"))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", _quoted(processor), _quoted(version), array, _quoted(config), schema.cast("string")), F.lit("]")), 256)


def safe_name(name: Column) -> Column:
    """A name that can be a file's: unsafe characters become _, spaces and dots at the ends go, nothing becomes _."""
    out = F.regexp_replace(F.regexp_replace(name, UNSAFE, "_"), r"^[ .]+|[ .]+$", "")
    return F.when(out == "", "_").otherwise(out)


def scope_sides(scope: Column) -> tuple[Column, Column]:
    """Left and right of a comparison's scope, written left:right."""
    parts = F.split(scope, ":")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def shortened(text: Column, most: int) -> Column:
    """The first characters of a text for a list; a mark shows that there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def version_in_range(version: Column, spec: str) -> Column:
    """True if a version's first four numbers satisfy all comparisons of a specification like '>=1.2,<2'. Parts that
    are no comparison ask nothing."""
    four = lambda c: F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")), 1, 4)
    out = F.lit(True)
    for part in spec.split(","):
        m = re.match(r"\s*(>=|<=|<|>|==)\s*(.+?)\s*$", part)
        if m:
            own, ref = four(version), F.lit([int(x) for x in re.findall(r"\d+", m[2])[:4]]).cast("array<int>")
            out = out & {">=": own >= ref, "<=": own <= ref, "<": own < ref, ">": own > ref, "==": own == ref}[m[1]]
    return out


def mixed_order(value: Column) -> Column:
    """A sort key for values of any kind, given as text: nothing first, then numbers by size, then text in lower case."""
    number = F.when(value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), value.try_cast("double"))
    kind = F.when(value.isNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(number, F.lit(0.0)).alias("number"), F.when(kind == 2, F.lower(value)).otherwise("").alias("text"))


def measured(family: Column) -> Column:
    """The value of a family (struct state, value) where it was measured; else null, never zero."""
    return F.when(family["state"] == "MEASURED", family["value"])


def public_metrics(metrics: Column, prefix: str = "strings_") -> Column:
    """A map of metrics without the sensitive ones."""
    return F.map_filter(metrics, lambda k, v: ~k.startswith(prefix))


def dotted(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON document, as text; null where a part is missing."""
    return F.get_json_object(document, "$." + path)


def local_time(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def row_matches(columns: list[str], needle: str, **equal) -> Column:
    """True for rows that show the needle in any column, whatever its case, and equal all given values."""
    shown = F.lower(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns)))
    out = shown.contains(needle.lower())
    for c, v in equal.items():
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out
