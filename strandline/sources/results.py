"""Results that come as files: a matcher's database, recorded exports, ground truths, key-value texts, scenario sets."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an algorithm of the second matcher looks at, by the first of these that its name holds.
ALGORITHMS = {
    "name hash": "identity", "manual": "identity", "prime signature": "instruction", "instruction count": "instruction", "hash matching": "instruction", "flowgraph md index": "cfg", "relaxed md index": "cfg", "loop count": "cfg",
    "callgraph md index": "callgraph", "call sequence": "callgraph", "call reference": "callgraph", "string references": "data-reference",
}
TRUTH = (
    "versions array<string>, components array<string>, functions map<string, map<string, map<string, bigint>>>, transitions array<struct<component: string, `from`: string, `to`: string, pairs: array<struct<left: bigint, right: bigint, name: string, relation: string>>, "
    "splits: array<struct<left: bigint, rights: array<bigint>>>, merges: array<struct<lefts: array<bigint>, right: bigint>>, new: array<struct<right: bigint, name: string, resurrects: struct<version: string, address: bigint>>>, disappeared: array<struct<left: bigint, name: string>>>>"
)


def algorithm_family(name: Column) -> Column:
    """The family of an algorithm's name; null for one that is no evidence, such as the order of addresses."""
    out = F.lit(None).cast("string")
    for fragment, family in reversed(ALGORITHMS.items()):
        out = F.when(F.lower(name).contains(fragment), family).otherwise(out)
    return out


def database_decision(name: Column, similarity: Column, confidence: Column) -> Column:
    exact = F.lower(name).contains("hash matching") & ~F.lower(name).contains("name") & (similarity >= 0.999)
    strong, probable = (similarity >= 0.9) & (confidence >= 0.9), (similarity >= 0.5) & (confidence >= 0.5)
    return F.when(exact, "EXACT").when(strong, "STRONG").when(probable, "PROBABLE").otherwise("UNRESOLVED")


def matcher_databases(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of the second matcher's databases, one file each: source, left, right, raw_score, confidence, algorithm, family,
    decision. A file that is no such database gives one row with `problem`."""
    kind = "source string, left long, right long, raw_score double, confidence double, algorithm string, problem string"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                base = sqlite3.connect(":memory:")
                try:
                    base.deserialize(bytes(content))
                    rows = base.execute("SELECT address1, address2, similarity, confidence, coalesce(name, algorithm) FROM function LEFT JOIN functionalgorithm a ON a.id = function.algorithm ORDER BY address1").fetchall()
                    out = [(source, int(a), int(b), float(s), float(c), str(n), None) for a, b, s, c, n in rows]
                except (sqlite3.Error, TypeError, ValueError) as e:
                    out = [(source, None, None, None, None, None, str(e))]
                finally:
                    base.close()
                yield pd.DataFrame(out, columns=["source", "left", "right", "raw_score", "confidence", "algorithm", "problem"]).astype({"left": "Int64", "right": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    out = files.mapInPandas(read, kind)
    decision = F.when(F.col("problem").isNull(), database_decision(F.col("algorithm"), F.col("raw_score"), F.col("confidence")))
    return out.withColumns({"family": algorithm_family(F.col("algorithm")), "decision": decision, "raw_score": F.round("raw_score", 4), "confidence": F.round("confidence", 4)})


def recorded(exports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Recorded exports (component: the digest in the file's name) for known artifacts (sha256). They are marked as replayed
    and never as verified; an artifact without one is skipped, and says so."""
    own = exports.withColumn("engine_version", F.lit("replay")).withColumn("verified", F.lit(False))
    out = artifacts.join(own, F.col("sha256") == F.col("component"), "left")
    return out.withColumn("skip", F.when(F.col("component").isNull(), "SKIPPED_INCOMPATIBLE"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth files, one row each, with their source."""
    return spark.read.schema(TRUTH).option("multiLine", "true").json(path).withColumn("source", F.input_file_name())


def truth_functions(truth: DataFrame) -> DataFrame:
    """source, component, version, name, address."""
    a = truth.select("source", F.explode("functions").alias("component", "_v")).select("source", "component", F.explode("_v").alias("version", "_f"))
    return a.select("source", "component", "version", F.explode("_f").alias("name", "address"))


def truth_relations(truth: DataFrame) -> DataFrame:
    """source, component, from, to, kind, left, right of all transitions; kind: pair, split, merge or return.

    A return leads from an earlier version's function, so its `from` is that version.
    """
    t = truth.select("source", F.explode("transitions").alias("t")).select("source", "t.component", F.col("t.from").alias("from"), F.col("t.to").alias("to"), "t.pairs", "t.splits", "t.merges", "t.new")
    keys = ["source", "component", "from", "to"]
    pairs = t.select(*keys, F.lit("pair").alias("kind"), F.explode("pairs").alias("x")).select(*keys, "kind", "x.left", "x.right")
    splits = t.select(*keys, F.lit("split").alias("kind"), F.explode("splits").alias("x")).select(*keys, "kind", "x.left", F.explode("x.rights").alias("right"))
    merges = t.select(*keys, F.lit("merge").alias("kind"), F.explode("merges").alias("x")).select(*keys, "kind", F.explode("x.lefts").alias("left"), "x.right")
    back = t.select(*keys, F.explode("new").alias("x")).where("x.resurrects IS NOT NULL").select("source", "component", F.col("x.resurrects.version").alias("from"), "to", F.lit("return").alias("kind"), F.col("x.resurrects.address").alias("left"), "x.right")
    return pairs.unionByName(splits).unionByName(merges).unionByName(back)


def logical_edges(relations: DataFrame) -> tuple[Column, Column]:
    """The two ends of a relation as vertices for truth.logical_functions."""
    name = lambda version, address: F.concat_ws("|", "source", "component", F.col(version), F.col(address).cast("string"))
    return name("from", "left"), name("to", "right")


def scenario_truth(scenarios: DataFrame) -> DataFrame:
    """Scenario sets (component, functions: version -> name -> address, scenarios: name -> struct versions, transitions) in the
    shape of ground truths, one row for each scenario."""
    own = scenarios.select("component", "functions", F.explode("scenarios").alias("scenario", "_s"))
    versions = F.col("_s.versions")
    functions = F.map_filter("functions", lambda v, _: F.array_contains(versions, v))
    return own.select("scenario", versions.alias("versions"), F.array("component").alias("components"), F.create_map("component", functions).alias("functions"), F.col("_s.transitions").alias("transitions"))


def dataset_digest(spark: SparkSession, path: str) -> DataFrame:
    """One digest of a folder: over the sorted names and digests of its files, recorded ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.array_contains(F.split("path", "/"), "golden"))
    line = F.concat_ws("\t", F.substring_index(F.col("path"), path.rstrip("/") + "/", -1), F.sha2("content", 256))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n_files"))


_MARK = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}])')


def key_values(text: Column) -> Column:
    """Quoted key-value text with nested braces, as JSON; of a key that repeats in a block the last value counts."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(_block(_MARK.finditer(t)), ensure_ascii=False)
            except RecursionError:  # braces nested beyond any use
                return None

        return texts.map(one)

    return run(text)


def _block(marks) -> dict:
    """What stands up to the closing brace, or the end; a name without a value is left out."""
    out: dict = {}
    name = None
    for m in marks:
        if m[2] == "}":
            break
        if m[2] == "{":
            inner = _block(marks)
            if name is not None:
                out[name], name = inner, None
        elif name is None:
            name = re.sub(r'\\(["\\])', r"\1", m[1])
        else:
            out[name], name = re.sub(r'\\(["\\])', r"\1", m[1]), None
    return out
