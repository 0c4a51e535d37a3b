"""Statistics over arrays, maps and grouped values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_HISTORY, UNUSUAL, EXTREME = 5, 3.5, 7.0
#: Share of a standard deviation that a median absolute deviation is.
MAD_SHARE = 0.6745


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """jaccard() of arrays without repeats: their sizes and what they share say how many they have together."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Of two histograms (maps to counts); 0 if one is empty."""
    zero = F.lit(0).cast("long")
    pair = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) * F.coalesce(y, zero))
    total = lambda m, f: F.aggregate(F.map_values(m), zero, lambda acc, v: acc + f(v))
    norm = F.sqrt(total(a, lambda v: v * v).cast("double")) * F.sqrt(total(b, lambda v: v * v).cast("double"))
    return F.coalesce(F.try_divide(total(pair, lambda v: v).cast("double"), F.nullif(norm, F.lit(0.0))), F.lit(0.0))


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the measured values only; null where nothing is measured."""
    top = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in values.items()), F.lit(0.0))
    low = sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    return top / F.nullif(low, F.lit(0.0))


def array_median(values: Column) -> Column:
    """Mean of the middle elements; null for an empty array."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(ordered, low) + F.try_element_at(ordered, high)) / 2)


def robust_class(value: Column, history: Column, median: Column, mad: Column) -> Column:
    """NORMAL, UNUSUAL or EXTREME against a history's median and MAD; UNKNOWN without enough of it."""
    z = F.abs(value - median) * MAD_SHARE / F.nullif(mad, F.lit(0.0))
    return (
        F.when(value.isNull() | (F.size(history) < MIN_HISTORY), "UNKNOWN")
        .when(mad == 0, F.when(value == median, "NORMAL").otherwise("EXTREME"))
        .when(z >= EXTREME, "EXTREME").when(z >= UNUSUAL, "UNUSUAL").otherwise("NORMAL")
    )


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; each null where its denominator is zero, F1 zero if both are."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
