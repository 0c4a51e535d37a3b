"""Family scores of all pairs of two blocks of functions, as matrices.

Both sides of a key are dealt to blocks and each pair of blocks is a group of its own. A group gets the numbers of its
functions and 64-bit hashes of what their sets hold, works a strip of rows at a time, and gives only the pairs that are
asked for. Scores are those of match.family_scores to the last bit: the same operations in the same order, rounded
as Spark rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _kept

#: Rows a side, about, that one group pairs with as many of the other side.
BLOCK = 2048
#: Pairs that are scored together, and entries of sets that are paired together.
STRIP, ENTRIES = 1 << 18, 1 << 22
#: Groups that return all their pairs are dealt to so many tasks at most, and the rows a side of one.
TASKS, WHOLE = 2048, 1024
#: A value is a matrix column if more than one in so many pairs share it, the first so many at most.
SHARE, COLUMNS = 75, 4096


def sized(old: DataFrame, new: DataFrame, block: int, by: list[str]) -> DataFrame:
    """Kept keys that both sides have, with the blocks of either side, _m and _n."""
    blocks = lambda side, n: side.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    return _kept(blocks(old, "_m").join(blocks(new, "_n"), by))


def dealt(old: DataFrame, new: DataFrame, block: int, by: list[str], ids: tuple[str, str], sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with _i and _j: each side of a key is dealt to blocks of about so many rows, and a row is there
    once for each block of the other side. sizes: sized(), if it is there."""
    sizes = sized(old, new, block, by) if sizes is None else sizes
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = old.join(sizes, by).withColumn("_i", own(ids[0], "_m")).withColumn("_j", every("_n")).drop("_m", "_n")
    b = new.join(sizes, by).withColumn("_j", own(ids[1], "_n")).withColumn("_i", every("_m")).drop("_m", "_n")
    return a, b


def called(x) -> Column:
    """What a function calls: matches of its callees, imports, names."""
    return F.concat(F.transform(x["linked"], lambda v: v.cast("string")), F.transform(x["imports"], lambda v: F.concat(F.lit("imp:"), v)), F.transform(x["callee_names"], lambda v: F.concat(F.lit("n:"), v)))


def items(x) -> Column:
    return F.concat(x["strings"], F.transform(x["constants"], lambda v: v.cast("string")))


def _hashed(values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.xxhash64(v))


def _of_function(x, linked: Column) -> list[Column]:
    """What a group needs of a function that calls linked."""
    own = lambda c: F.when(x[c].isNotNull(), F.xxhash64(x[c])).alias(c)
    return [
        *(x[c].cast("double").alias(c) for c in ("insn_count", "cfg_blocks", "cfg_edges", "cyclomatic")), *(F.size(x[c]).cast("double").alias(c) for c in ("callees", "callers")), *(own(c) for c in ("normalized_hash", "cfg_hash", "name")),
        F.transform(F.map_keys(x["mnemonics"]), lambda k: F.xxhash64(k)).alias("words"), F.map_values(x["mnemonics"]).alias("counts"), _hashed(called({**x, "linked": linked})).alias("called"), _hashed(items(x)).alias("items"),
    ]


#: The features that numbers() reads, and the column that has what they give once for all.
FEATURES, FIXED = ("insn_count", "mnemonics", "normalized_hash", "cfg_blocks", "cfg_edges", "cyclomatic", "cfg_hash", "callees", "callers", "callee_names", "imports", "strings", "constants", "name"), "numbers"


def prepared(functions: DataFrame) -> DataFrame:
    """Functions with a column of what numbers() makes of them, so that it is made once; only matches of callees are missing."""
    return functions.withColumn(FIXED, F.struct(*_of_function({c: F.col(c) for c in FEATURES}, F.array().cast("array<bigint>"))))


def _linked(values: Column) -> Column:
    """Hashes of matches of callees; no name or import has the hash of a number."""
    return _hashed(F.transform(values, lambda v: v.cast("string")))


def hashes(*keys: str) -> Column:
    """A struct as match.scored() takes it of prepared functions with matched callees."""
    x = F.col(FIXED)
    return F.struct(
        *keys, "insn_count", "cfg_blocks", "cfg_edges", "cyclomatic", "normalized_hash", "cfg_hash", "name", "callees", "callers",
        F.map_from_arrays(x["words"], x["counts"]).alias("mnemonics"), F.concat(_linked(F.col("linked")), x["called"]).alias("called"), x["items"].alias("items"),
    )


def numbers(f: DataFrame, *keys: str, of: str | None = None) -> DataFrame:
    """keys and what a group needs of a function, whose features are columns or the fields of the struct of."""
    own = f.schema[of].dataType if of else f.schema
    x = {c: F.col(f"{of}.{c}" if of else c) for c in own.names}
    if FIXED not in x:
        return f.select(*keys, *_of_function(x, x["linked"]))
    return f.select(*keys, *(F.concat(_linked(x["linked"]), x[FIXED][c]).alias(c) if c == "called" else x[FIXED][c].alias(c) for c in own[FIXED].dataType.names))


class Sets:
    """Sets of a block of rows as lengths, NaN for null, and values."""

    def __init__(self, n: int, own: dict[str, pa.Array], *of: str):
        self.n = n
        self.length = {c: own[c].value_lengths().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in of}
        self.values = {c: own[c].flatten().to_numpy() for c in of}

    def row(self, of: str) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.nan_to_num(self.length[of]).astype(int))


class Side(Sets):
    """A block of functions: numbers with NaN for null, hashes with a mask, sets."""

    def __init__(self, rows: pa.Table):
        own = {c: rows[c].combine_chunks() for c in rows.column_names}
        super().__init__(rows.num_rows, own, "words", "called", "items")
        self.number = {c: own[c].to_numpy(zero_copy_only=False) for c in ("insn_count", "cfg_blocks", "cfg_edges", "cyclomatic", "callees", "callers")}
        self.hash = {c: (own[c].is_valid().to_numpy(zero_copy_only=False), own[c].fill_null(0).to_numpy()) for c in ("normalized_hash", "cfg_hash", "name")}
        self.counts = own["counts"].flatten().to_numpy().astype(float)
        squares = np.bincount(self.row("words"), self.counts**2, self.n)
        self.norm = np.where(np.isnan(self.length["words"]), np.nan, np.sqrt(squares))


class Shared:
    """What rows of two sides have in common in one of their sets: the number of values, or the sum of the products of
    their counts. Frequent values are columns of matrices; of the others the rows that have them are paired."""

    def __init__(self, l: Sets, r: Sets, of: str, counted: bool = False):  # noqa: E741
        va, vb = l.values[of], r.values[of]
        wa, wb = (l.counts, r.counts) if counted else (np.ones(len(va)), np.ones(len(vb)))
        values, code = np.unique(np.concatenate([va, vb]), return_inverse=True)
        a, b = code[: len(va)], code[len(va) :]
        na, self.times = (np.bincount(x, minlength=len(values)) for x in (a, b))
        met = na * self.times
        often = met * SHARE > l.n * r.n
        if often.sum() > COLUMNS:
            often &= met > np.partition(met, -COLUMNS)[-COLUMNS]
        place = np.cumsum(often) - 1

        def matrix(side: Side, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
            out, some = np.zeros((side.n, int(often.sum()))), often[codes]
            out[side.row(of)[some], place[codes[some]]] = weights[some]
            return out

        self.m, self.left, self.right = r.n, matrix(l, a, wa), np.ascontiguousarray(matrix(r, b, wb).T)
        rare = ~often[a] & (self.times[a] > 0)
        self.row, self.code, self.weight = l.row(of)[rare], a[rare], wa[rare]
        order = np.argsort(b, kind="stable")
        self.start, self.other, self.other_weight = np.concatenate([[0], np.cumsum(self.times)]), r.row(of)[order], wb[order]

    def strip(self, lo: int, hi: int) -> np.ndarray:
        out = self.left[lo:hi] @ self.right
        at, end = np.searchsorted(self.row, [lo, hi])
        ends = np.cumsum(self.times[self.code[at:end]])
        done = 0
        while at < end:
            n = max(1, int(np.searchsorted(ends, done + ENTRIES)) - len(ends) + end - at)
            code = self.code[at : at + n]
            times = self.times[code]
            first = np.cumsum(times) - times
            other = np.arange(times.sum()) + np.repeat(self.start[code] - first, times)
            cell = np.repeat((self.row[at : at + n] - lo) * self.m, times) + self.other[other]
            out += np.bincount(cell, np.repeat(self.weight[at : at + n], times) * self.other_weight[other], out.size).reshape(out.shape)
            done += int(times.sum())
            at += n
        return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To four places, halves up by the shortest decimal digits of a number, as Spark's round()."""
    at = x * 1e4 + 0.5
    out = np.floor(at) / 1e4
    close = np.abs(at - np.rint(at)) < 1e-6
    if close.any():
        some, which = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in some])[which]
    return out


def size_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.abs(a - b) / np.maximum(np.maximum(a, b), 1)


def weighted(families: dict[str, np.ndarray], weights: dict[str, float]) -> np.ndarray:
    """The rounded mean of the measured families; 0 where nothing is measured."""
    top = low = 0.0
    for k, v in families.items():
        there = ~np.isnan(v)
        top = top + np.where(there, v * weights[k], 0.0)
        low = low + np.where(there, weights[k], 0.0)
    return np.nan_to_num(rounded(top / np.where(low == 0, np.nan, low)))


def strips(l: Side, r: Side) -> Iterator[tuple[int, int, dict[str, np.ndarray], dict[str, np.ndarray]]]:  # noqa: E741
    """(first row, last row + 1, families, facts) of all pairs, some left rows at a time; null is NaN. facts: data (the
    similarity of items before it is rounded), code (equal code), differ (two names), size (both instruction counts)."""
    dots, calls, data = Shared(l, r, "words", True), Shared(l, r, "called"), Shared(l, r, "items")
    step = max(1, STRIP // max(1, r.n))
    for lo in range(0, l.n, step):
        hi = min(l.n, lo + step)
        a = {k: v[lo:hi, None] for k, v in l.number.items()}
        ratio = {k: size_ratio(a[k], v[None, :]) for k, v in r.number.items()}

        def same(c: str) -> tuple[np.ndarray, np.ndarray]:
            (there, value), (other, equal) = l.hash[c], r.hash[c]
            both = there[lo:hi, None] & other[None, :]
            return both, both & (value[lo:hi, None] == equal[None, :])

        def jaccard(of: str, shared: np.ndarray) -> np.ndarray:
            joint = l.length[of][lo:hi, None] + r.length[of][None, :] - shared
            return shared / np.where(joint == 0, np.nan, joint)

        _, code = same("normalized_hash")
        _, graph = same("cfg_hash")
        named, name = same("name")
        norm = l.norm[lo:hi, None] * r.norm[None, :]
        cosine = np.nan_to_num(dots.strip(lo, hi) / np.where(norm == 0, np.nan, norm))
        shape = (ratio["cfg_blocks"] + ratio["cfg_edges"] + ratio["cyclomatic"]) / 3 * 0.9
        degree = (ratio["callees"] + ratio["callers"]) / 2
        sets = (jaccard("called", calls.strip(lo, hi)) + degree) / 2
        near = jaccard("items", data.strip(lo, hi))
        families = {
            "instruction": rounded(np.where(code, 1.0, cosine * np.sqrt(ratio["insn_count"]))), "cfg": rounded(np.where(graph, 1.0, shape)), "callgraph": rounded(np.where(np.isnan(sets), degree, sets)),
            "data-reference": rounded(near), "identity": np.where(named, name.astype(float), np.nan),
        }
        yield lo, hi, families, {"data": near, "code": code, "differ": named & ~name, "size": (a["insn_count"], r.number["insn_count"][None, :])}


def grouped(old: DataFrame, new: DataFrame, by: list[str], ids: tuple[str, str], of: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK, spread: bool = False) -> DataFrame:
    """of(left rows, right rows) of every pair of blocks of a key. spread: as many tasks as groups, as what goes in is
    little beside what comes out."""
    sizes = sized(old, new, block, by)
    a, b = dealt(old, new, block, by, ids, sizes)
    keys = [*by, "_i", "_j"]
    if spread:
        groups = sizes.agg(F.sum(F.col("_m").cast("long") * F.col("_n"))).first()[0] or 1
        a, b = (side.repartition(min(TASKS, groups), *keys) for side in (a, b))
    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # both sides may come from one frame
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda l, r: of(l, r), schema)  # noqa: E741


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """scalar.compatible(), where NaN is null."""
    return (np.fmin(a, b) * 3 >= np.fmax(a, b)) | (np.abs(a - b) <= 4)


def item_pairs(left: pa.Table, right: pa.Table, scale: int) -> pa.Table:
    """component, left, right, data_score, ratio of all size-compatible pairs: the similarity of their items and of their
    sizes, in whole parts of scale."""
    schema = pa.schema([("component", left.schema.field("component").type), *((c, pa.int64()) for c in ("left", "right", "data_score", "ratio"))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    keys, sizes, sets = [], [], []
    for rows in (left, right):
        own = {c: rows[c].combine_chunks() for c in rows.column_names}
        keys.append(own["entry"].to_numpy())
        sizes.append(own["insn_count"].cast(pa.float64()).to_numpy(zero_copy_only=False))
        sets.append(Sets(rows.num_rows, own, "items"))
    (l, r), (ours, others) = sets, sizes  # noqa: E741
    items, step, out = Shared(l, r, "items"), max(1, STRIP // r.n), []

    def parts(x: np.ndarray) -> pa.Array:
        whole, none = np.floor(x * scale + 0.000001), np.isnan(x)
        return pa.array(np.where(none, 0, whole).astype(np.int64), mask=none if none.any() else None)

    for lo in range(0, l.n, step):
        hi = min(l.n, lo + step)
        i, j = np.nonzero(_compatible(ours[lo:hi, None], others[None, :]))
        shared = items.strip(lo, hi)[i, j]
        i += lo
        joint = l.length["items"][i] + r.length["items"][j] - shared
        data = shared / np.where(joint == 0, np.nan, joint)
        columns = [pa.repeat(left["component"][0], len(i)), pa.array(keys[0][i]), pa.array(keys[1][j]), parts(data), parts(size_ratio(ours[i], others[j]))]
        out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
    return pa.Table.from_batches(out, schema)


def best_pairs(left: pa.Table, right: pa.Table, weights: dict[str, float], least: float | None, n: int) -> pa.Table:
    """component, left, right, score of size-compatible pairs that score at least so much, or are among the n best of their left row."""
    right = right.sort_by("entry")
    keys, others = left["entry"].combine_chunks(), right["entry"].combine_chunks()
    cells, scores = [np.zeros(0, int)], [np.zeros(0)]
    if left.num_rows and right.num_rows:
        l, r = Side(left), Side(right)  # noqa: E741
        for lo, hi, families, facts in strips(l, r):
            a, b = facts["size"]
            score = np.where(_compatible(a, b), weighted(families, weights), -1.0)
            rows = np.arange(hi - lo)
            if least is not None:
                i, j = np.nonzero(score >= least)
                cells.append((i + lo) * r.n + j)
                scores.append(score[i, j])
            for _ in range(n):
                j = np.argmax(score, axis=1)
                top = score[rows, j]
                some = (top >= 0) & (least is None or top < least)
                cells.append(((rows + lo) * r.n + j)[some])
                scores.append(top[some])
                score[rows, j] = -1.0
    cell = np.concatenate(cells)
    i, j = np.divmod(cell, max(1, right.num_rows))
    component = left["component"].combine_chunks().take(pa.array(i))
    return pa.table({"component": component, "left": keys.take(pa.array(i)), "right": others.take(pa.array(j)), "score": pa.array(np.concatenate(scores))})
