"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all but the last
return the columns of documents, in their order: other columns are left out, whatever their names.
An empty table gives empty results. Null texts are empty, null ids are ids of their own, and rows that
are alike in id and text are one document, which stays or goes as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir, table
from strandline.llm.op1_decontamination import decontaminate
from strandline.llm.op2_bpe import digests, round_trip
from strandline.llm.op8_line_dedup import dedup_lines
from strandline.llm.op9_toxicity import score, train
from strandline.llm.op10_near_dedup import near_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not predict as toxic.

    Null and empty texts have the score of a text without words; without labels nothing goes unless all are toxic.
    """
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated three-line passages; documents with nothing else in them go.

    Texts that lose nothing stay as they are, null and empty ones too; n_chars follows a text that does.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    return out.where(left).select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Null and empty texts are in no group and stay. Of rows that repeat an id with different texts, the one
    with the least hash of its text stands for the id.
    """
    docs = docs.select(*COLUMNS)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = near_components(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(text).alias("_hash")).join(kept, "_id", "left_semi")
    unnamed = kept.where("_id IS NULL").withColumn("_hash", F.lit(None).cast("long"))
    stays = named.unionByName(unnamed)
    same = docs["doc_id"].eqNullSafe(stays["_id"]) & (stays["_hash"].isNull() | (text == stays["_hash"]))
    return docs.join(stays, same, "left_semi").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts, which have none, stay."""
    docs = docs.select(*COLUMNS)
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]), "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digests of the ids and of the text that they decode to; null and empty texts have no ids."""
    return digests(round_trip(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]
#: The trees, the signatures and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
