"""Scalar column functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_ratio(a: Column, b: Column) -> Column:
    """1 for equal sizes, towards 0 the further apart they are."""
    return 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def compatible(a: Column, b: Column) -> Column:
    """Sizes within a factor of three, or within four."""
    return (F.least(a, b) * 3 >= F.greatest(a, b)) | (F.abs(a - b) <= 4)


def cyclomatic(blocks: Column, edges: Column) -> Column:
    return F.greatest(F.lit(1), edges - blocks + 2)


def bucket(n: Column, edges: dict[str, int], over: str = "XL") -> Column:
    """The first name whose edge n does not exceed; null is UNKNOWN, not small."""
    out = F.lit(over)
    for name, edge in reversed(list(edges.items())):
        out = F.when(n <= edge, name).otherwise(out)
    return F.when(n.isNull(), "UNKNOWN").otherwise(out)


def context_key(**parts: Column) -> Column:
    """k=v pairs in the order of their names; a null is spelt None."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in sorted(parts.items())))


def partial_day(text: Column) -> Column:
    """The first day of a date given as YYYY, YYYY-MM or longer; null where it is none."""
    full = F.when(F.length(text) >= 10, F.substring(text, 1, 10)).otherwise(F.substring(F.concat(text, F.lit("-01-01")), 1, 10))
    return F.when(full.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(full, "yyyy-MM-dd"))


def default_name(name: Column, source: Column) -> Column:
    """True for a name that a tool made up."""
    return name.isNull() | (source == "DEFAULT") | name.rlike("^(FUN_|thunk_FUN_|LAB_|SUB_)")


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def version_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def strength(decision: Column) -> Column:
    """The strength class of a matching decision."""
    return (
        F.when(decision.isin("EXACT", "STRONG"), "HIGH").when(decision == "PROBABLE", "MEDIUM").when(decision == "ABSTAIN", "UNKNOWN").otherwise("LOW")
    )


def evidence_strength(source: Column, ref: Column, corroborated: Column) -> Column:
    """Correlation only: a named, corroborated official or research source is MEDIUM, all else LOW."""
    return F.when(ref.isNotNull() & source.isin("OFFICIAL", "RESEARCH") & corroborated, "MEDIUM").otherwise("LOW")


def sanitized(text: Column) -> Column:
    """Mail addresses, dotted addresses, long hexadecimal and long digit runs replaced by marks."""
    for pattern, mark in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "<mail>"),
        (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<address>"),
        (r"[0-9a-f]{32,}", "<hex>"),
        (r"[0-9]{9,}", "<number>"),
    ):
        text = F.regexp_replace(text, pattern, mark)
    return text
