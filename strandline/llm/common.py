"""What the operators of this package share: tables, the shared folder, staged results."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (tests on one machine) a temporary folder is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="strandline-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut there.

    A lost executor costs only the tasks it held; what was written stays readable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, through its own file system, and give its full path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return system.makeQualified(path).toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; Spark deletes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def rows_within(df: DataFrame, limit: int) -> bool:
    """True if df has at most so many rows; reads no more than are needed to tell."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if its checked row count is within limit, else df itself."""
    return F.broadcast(df) if rows_within(df, limit) else df


#: Rows from which on a key is frequent, and frequent keys that are broadcast at most.
HOT, FREQUENT = 1_000, 100_000


def meeting(rows: DataFrame, groups: DataFrame, key: list[str], spread: list[str], n: str = "_n", hot: int = HOT, most: int = FREQUENT) -> DataFrame:
    """rows joined to the groups of their keys, rows without one too; groups: one row for each key, with n, its rows.

    The groups of frequent keys come by broadcast: there are at most so many as there are rows by hot, and if
    that could be more than most, only the most frequent ones do. Their rows take part in the other join under a
    key of their own (a hash of spread), so that no task gets all rows of one of them. groups should be cheap to
    read again, and have no columns of rows but the key.
    """
    total = groups.agg(F.sum(n).alias("rows")).first()["rows"] or 0
    limit = max(hot, -(-total // most))
    rest = F.struct(*(c for c in groups.columns if c not in key))
    frequent = groups.where(F.col(n) >= limit).select(*key, rest.alias("_hot"))
    here = rows.join(small(frequent, most), key, "left")
    first, *others = key
    own = F.when(F.col("_hot").isNotNull(), F.xxhash64(*spread).cast(rows.schema[first].dataType)).otherwise(F.col(first))
    here = here.withColumn("_own", own)
    cold = groups.where(F.col(n) < limit).select(*(F.col(k).alias(f"_c_{k}") for k in key), rest.alias("_cold"))
    same = F.col("_hot").isNull() & (F.col("_own") == F.col(f"_c_{first}"))
    for k in others:
        same &= F.col(k) == F.col(f"_c_{k}")
    return here.join(cold, same, "left").withColumn("_g", F.coalesce("_hot", "_cold")).select(*rows.columns, "_g.*")


def freeing(run):
    """A function for mapInArrow that, at the end of its task, gives the memory it no longer needs back to
    the system. Workers wait for their next task beside the JVM, and would hold it all that time."""

    @functools.wraps(run)
    def freed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return freed
