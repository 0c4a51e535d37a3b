"""Function features: from disassembly exports, and the adapter that reads documents as functions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cyclomatic, default_name
from .graph import _kept
from .match import few


@F.pandas_udf(T.StringType())
def graph_hash(blocks: pd.Series) -> pd.Series:
    """Digest of a control-flow graph: two rounds of relabelling by the labels of successors.

    blocks: array of struct(start, succ). Graphs are local to a row, so each needs no join.
    """
    import hashlib

    def one(own) -> str | None:
        if own is None or not len(own):
            return None
        succ = {b["start"]: [s for s in (b["succ"] if b["succ"] is not None else ())] for b in own}
        known = {k: [s for s in v if s in succ] for k, v in succ.items()}
        into = dict.fromkeys(succ, 0)
        for v in known.values():
            for s in v:
                into[s] += 1
        label = {k: f"{len(known[k])}:{into[k]}" for k in succ}
        for _ in range(2):
            label = {k: hashlib.sha1((label[k] + "|" + ",".join(sorted(label[s] for s in known[k]))).encode()).hexdigest() for k in succ}
        return hashlib.sha1(",".join(sorted(label.values())).encode()).hexdigest()

    return blocks.map(one)


def _with(value: Column, f) -> Column:
    """f(value), where value is computed once, however often f refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def histogram(values: Column) -> Column:
    """A map from each value of an array to its count: the lengths of the runs of the sorted array."""

    def counted(ordered: Column) -> Column:
        first = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        return _with(first, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(ordered, i)), F.transform(at, lambda i, k: (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long"))))

    return F.when(values.isNotNull(), _with(F.sort_array(values), counted))


def callee_names(functions: DataFrame) -> DataFrame:
    """component, entry, callee_names of functions that call a named one: the real names of what they call."""
    calls = functions.select("component", F.col("entry").alias("caller"), F.explode("callees").alias("entry"))
    found = calls.join(functions.select("component", "entry", "name").where("name IS NOT NULL"), ["component", "entry"])
    return found.groupBy("component", F.col("caller").alias("entry")).agg(F.array_sort(F.collect_set("name")).alias("callee_names"))


def with_callee_names(functions: DataFrame) -> DataFrame:
    """Functions with the names of what they call, which the adapter leaves empty: only who compares calls needs the join."""
    names = few(_kept(callee_names(functions)))
    out = functions.drop("callee_names").join(names, ["component", "entry"], "left")
    return out.withColumn("callee_names", F.coalesce("callee_names", F.array().cast("array<string>")))


def from_export(functions: DataFrame) -> DataFrame:
    """Feature frame of exported functions: component, entry, name, name_source, size, blocks
    (struct start, size, succ), insns (array of [mnemonic, operands]), calls, imports, strings, constants.

    Callers are calls turned round; callee names are the real names of called functions.
    """
    own = functions.withColumn("name", F.when(~default_name(F.col("name"), F.col("name_source")), F.col("name")))
    calls = own.select("component", F.col("entry").alias("caller"), F.explode(F.array_distinct("calls")).alias("entry"))
    callers = calls.groupBy("component", "entry").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    names = callee_names(own.withColumn("callees", F.array_distinct("calls")))
    edges = F.aggregate("blocks", F.lit(0), lambda acc, b: acc + F.size(b["succ"]))
    lines = F.transform("insns", lambda i: F.concat_ws(" ", i))
    mnemonics = F.transform("insns", lambda i: i[0])
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    out = own.join(callers, ["component", "entry"], "left").join(names, ["component", "entry"], "left")
    return out.select(
        "component", "entry", F.size("insns").alias("insn_count"), histogram(mnemonics).alias("mnemonics"), F.when(F.size("insns") > 0, F.sha2(F.array_join(lines, "\n"), 256)).alias("normalized_hash"),
        F.size("blocks").alias("cfg_blocks"), edges.alias("cfg_edges"), cyclomatic(F.size("blocks"), edges).alias("cyclomatic"), graph_hash("blocks").alias("cfg_hash"),
        F.array_sort(F.array_distinct("calls")).alias("callees"), empty("callers", "bigint").alias("callers"), empty("callee_names", "string").alias("callee_names"), "imports", "strings", "constants", "name", "size",
    )


def extraction_quality(blocks: DataFrame, functions: DataFrame) -> DataFrame:
    """Per component: share of executable bytes that functions cover, at most 1; null without any."""
    code = blocks.where("execute").groupBy("component").agg(F.sum("size").alias("code"))
    covered = functions.groupBy("component").agg(F.sum("size").alias("covered"))
    return code.join(covered, "component", "left").select("component", F.least(F.lit(1.0), F.try_divide(F.coalesce("covered", F.lit(0)), F.nullif("code", F.lit(0)))).alias("coverage"))


_STRINGS = T.ArrayType(T.StringType())
_WORDS = T.StructType().add("code", T.StringType()).add("words", _STRINGS).add("counts", T.ArrayType(T.LongType())).add("imports", _STRINGS)


@F.pandas_udf(_WORDS)
def _words(texts: pd.Series) -> pd.DataFrame:
    """Of lower-case texts: the digest of all words, each word with its count, the long ones."""
    import hashlib
    import re
    from collections import Counter

    word, out = re.compile("[a-z]+"), []
    for text in texts:
        if text is None:
            out.append((None,) * 4)
            continue
        own = word.findall(text)
        counts = Counter(own)
        ordered = sorted(counts)
        code = hashlib.md5("".join(own).encode()).hexdigest() if own else None
        out.append((code, ordered, [counts[w] for w in ordered], [w for w in counts if len(w) >= 12]))
    return pd.DataFrame(out, columns=["code", "words", "counts", "imports"], dtype=object)


def documents_as_functions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The adapter: a (lang, source) is a component, its documents are functions of two sides.

    Words are instructions, lines blocks, digit runs constants, distinct lines strings, long words
    imports; a first word of four letters or more is a name; a document calls the next two of its side.
    Documents have no graph to hash; names of what they call come by with_callee_names().
    """
    lines, first = F.split("text", "\n"), F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    own = docs.select(
        F.concat_ws(":", "lang", "source").alias("component"), F.col("doc_id").alias("entry"), (F.floor(F.col("doc_id") / 20) % 2).alias("side"), F.regexp_count(F.lower("text"), F.lit("[a-z]+")).alias("insn_count"), _words(F.lower("text")).alias("w"), lines.alias("ls"), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("digits"), first.alias("first"), F.length("text").cast("long").alias("size"),
    )
    sizes = own.select(
        "component", "entry", "side", "size", "insn_count", F.map_from_arrays("w.words", "w.counts").alias("mnemonics"), F.col("w.code").alias("normalized_hash"),
        F.size("ls").alias("cfg_blocks"), F.size("w.words").alias("cfg_edges"), cyclomatic(F.size("ls"), F.size("w.words")).alias("cyclomatic"), F.lit(None).cast("string").alias("cfg_hash"),
        F.array(F.col("entry") + 40, F.col("entry") + 80).alias("callees"), F.array(F.col("entry") - 40, F.col("entry") - 80).alias("callers"), F.array().cast("array<string>").alias("callee_names"),
        F.col("w.imports").alias("imports"), F.array_distinct("ls").alias("strings"), F.array_distinct("digits").alias("constants"),
        F.when(F.length("first") >= 4, F.col("first")).alias("name"),
    )
    return sizes.where("side = 0").drop("side"), sizes.where("side = 1").drop("side")
