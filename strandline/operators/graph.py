"""Connected components and closures over edge lists."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary one; any other has none to give.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    own = context._jsc.sc().getCheckpointDir()
    if path is None and own.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandline-")
    if own.isEmpty():
        context.setCheckpointDir(path)
    return (path or own.get()).rstrip("/")


class Scratch:
    """Rows that one piece of work needs and nothing after it: written once as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class _Work(threading.local):
    """The pieces of work that a thread is in, the innermost last."""

    def __init__(self):
        self.open: list[Scratch] = []


_work = _Work()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Until its end all kept rows go to a folder that is deleted then; outliving() takes frames out of it."""
    own = Scratch(spark)
    _work.open.append(own)
    try:
        yield own
    finally:
        _work.open.remove(own)
        own.delete()


def outliving(own: Scratch, *frames: DataFrame) -> list[DataFrame]:
    """Frames of a piece of work, kept beyond it."""
    at = _work.open.index(own)
    inner, _work.open[at:] = _work.open[at:], []
    try:
        return [_kept(f) for f in frames]
    finally:
        _work.open += inner


def _kept(df: DataFrame) -> DataFrame:
    """Cut the plan in the shared folder.

    Inside a piece of work (scratch) rows are written as Parquet. Elsewhere they are checkpointed, and Spark
    deletes the files with the last reference; as a checkpoint computes its rows twice, once to count and
    once to write them, they are held on the executors' disks in between.
    """
    if _work.open:
        return _work.open[-1].keep(df)
    folder(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


class Grown:
    """Rows that come step by step: each step is appended to a folder, and nothing is written twice."""

    def __init__(self, spark: SparkSession, name: str, schema: str | T.StructType, by: str | None = None):
        self.spark, self.by = spark, by
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.path = f"{_work.open[-1].path if _work.open else folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.write(spark.createDataFrame([], self.schema))

    def write(self, df: DataFrame) -> DataFrame:
        out = df.select(*self.schema.names).write.mode("append")
        (out.partitionBy(self.by) if self.by else out).parquet(self.path)
        return df

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, component): the least vertex that each vertex of edges (a, b) reaches.

    Least labels go along the edges, and each round every label also takes its own label's label
    (pointer jumping), so that long paths shorten by half. Ends when a round changes nothing.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = _kept(both)
    nodes = both.select(F.col("a").alias("v"))
    labels = _kept((nodes if vertices is None else nodes.unionByName(vertices.select("v"))).distinct().withColumn("component", F.col("v")))
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy(both["a"]).agg(F.min("component").alias("m"))
        near = labels.join(heard, labels["v"] == heard["a"], "left").select("v", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("before"))
        up = near.select(F.col("v").alias("w"), F.col("component").alias("up"))
        jumped = near.join(up, near["component"] == up["w"]).select("v", F.least("component", "up").alias("component"), "before")
        jumped = _kept(jumped)
        labels = jumped.select("v", "component")
        if jumped.where("component <> before").isEmpty():
            return labels


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Vertices that edges (parent, child) lead to from roots (v), roots too. Cycles end.

    A round for each level, however many there are; what a level finds is appended to what was seen.
    """
    front = _kept(roots.select("v").distinct())
    seen = Grown(front.sparkSession, "seen", front.schema)
    while not front.isEmpty():
        seen.write(front)
        new = front.join(edges, front["v"] == edges["parent"]).select(F.col("child").alias("v")).distinct()
        front = _kept(new.join(seen.read(), "v", "left_anti"))
    return seen.read()
