"""Members of zip archives: listed, judged before anything is unpacked, then read in bounded pieces by executors."""

from __future__ import annotations

import hashlib
import io
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import _kept
from ..operators.store import members_checked

PIECE = 1 << 20
LISTED = "archive string, place int, name string, bytes long, packed long, encrypted boolean, link boolean, problem string"
LINES = "archive string, member string, line long, text string, problem string"
DIGESTS = "archive string, member string, bytes long, sha256 string, problem string"
_LISTED = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("packed", pa.int64()), ("encrypted", pa.bool_()), ("link", pa.bool_()), ("problem", pa.string())])
_LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("problem", pa.string())])
_DIGESTS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("problem", pa.string())])


@dataclass(frozen=True)
class Limits:
    """Members of an archive, bytes of one unpacked, of all, and how many times its packed size one may have."""

    members: int = 10_000
    member_bytes: int = 256 << 20
    total_bytes: int = 2 << 30
    ratio: int = 200


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def _opened(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        return None


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == most or size > 8 * PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of their members, nothing unpacked: a row each; one with `problem` for a file that is no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    zipped = _opened(content)
                    if zipped is None:
                        yield archive, None, None, None, None, None, None, "no archive"
                        continue
                    for k, m in enumerate(zipped.infolist()):
                        yield archive, k, m.orig_filename, m.file_size, m.compress_size, bool(m.flag_bits & 1), stat.S_ISLNK(m.external_attr >> 16), None

        yield from _batches(rows(), _LISTED)

    return _files(spark, path).mapInArrow(run, LISTED)


def checked(spark: SparkSession, path: str, limits: Limits = Limits(), required: tuple[str, ...] = ()) -> DataFrame:
    """Members with `problem`; an archive of which one member is unsafe, or that lacks a required one, is refused whole."""
    own = _kept(listed(spark, path))
    bad = own.where("problem IS NOT NULL").select("archive", "place", "name", "bytes", "problem")
    members = members_checked(own.where("problem IS NULL").drop("problem"), "archive", limits.members, limits.member_bytes, limits.total_bytes, limits.ratio).select("archive", "place", "name", "bytes", "problem")
    lacking = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.collect_set("name"))
    missing = members.groupBy("archive").agg(lacking.alias("_m")).where(F.size("_m") > 0)
    missing = missing.select("archive", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("bytes"), F.concat(F.lit("lacks "), F.array_join(F.array_sort("_m"), ", ")).alias("problem"))
    out = _kept(members.unionByName(bad).unionByName(missing))
    refused = out.where("problem IS NOT NULL").select("archive").distinct().withColumn("refused", F.lit(True))
    return out.join(refused, "archive", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


def _safe(spark: SparkSession, path: str, limits: Limits, required: tuple[str, ...]) -> DataFrame:
    good = checked(spark, path, limits, required).where("NOT refused").select(F.col("archive").alias("path")).distinct()
    return _files(spark, path).join(good, "path", "left_semi")


def _pieces(zipped: zipfile.ZipFile, member: zipfile.ZipInfo) -> Iterator[bytes]:
    """A member's bytes, as many as it says and no more."""
    left = member.file_size
    with zipped.open(member) as file:
        while True:
            piece = file.read(min(PIECE, left + 1))
            if not piece:
                break
            left -= len(piece)
            if left < 0:
                raise ValueError("more bytes than the archive says")
            yield piece
    if left:
        raise ValueError("fewer bytes than the archive says")


def lines(spark: SparkSession, path: str, limits: Limits = Limits(), required: tuple[str, ...] = (), suffix: str = ".jsonl") -> DataFrame:
    """archive, member, line (from 0), text of every line of the members with a suffix, of archives that are not refused.

    Members are unpacked in pieces; of a line only itself is held. Empty lines are left out. A member that is
    damaged, or is not what its archive says, gives its lines up to there and then a row with `problem`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    zipped = _opened(content)
                    for member in zipped.infolist():
                        if member.is_dir() or not member.filename.endswith(suffix):
                            continue
                        n, rest = 0, b""
                        try:
                            for piece in _pieces(zipped, member):
                                *whole, rest = (rest + piece).split(b"\n")
                                for x in whole:
                                    if x.strip():
                                        yield archive, member.filename, n, x.decode("utf-8"), None
                                    n += 1
                            if rest.strip():
                                yield archive, member.filename, n, rest.decode("utf-8"), None
                        except (zipfile.BadZipFile, ValueError, EOFError, OSError, NotImplementedError) as e:
                            yield archive, member.filename, n, None, str(e)[:200]

        yield from _batches(rows(), _LINES)

    return _safe(spark, path, limits, required).mapInArrow(run, LINES)


def digests(spark: SparkSession, path: str, limits: Limits = Limits(), required: tuple[str, ...] = ()) -> DataFrame:
    """archive, member, bytes, sha256 of the members of archives that are not refused, as they unpack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    zipped = _opened(content)
                    for member in zipped.infolist():
                        if member.is_dir():
                            continue
                        h, n = hashlib.sha256(), 0
                        try:
                            for piece in _pieces(zipped, member):
                                h.update(piece)
                                n += len(piece)
                            yield archive, member.filename, n, h.hexdigest(), None
                        except (zipfile.BadZipFile, ValueError, EOFError, OSError, NotImplementedError) as e:
                            yield archive, member.filename, n, None, str(e)[:200]

        yield from _batches(rows(), _DIGESTS)

    return _safe(spark, path, limits, required).mapInArrow(run, DIGESTS)


def pack_problems(spark: SparkSession, path: str, limits: Limits = Limits(), known: int = 1) -> DataFrame:
    """archive, member, problem of packs: unsafe members, a manifest of a newer layout, and members whose size or digest
    is not what manifest.json (schema_version, files: path, size_bytes, sha256) and checksums.txt (digest, two spaces,
    path) say, or that only one of the three names. A pack without rows is whole."""
    required = ("manifest.json", "checksums.txt")
    judged = _kept(checked(spark, path, limits, required))
    unsafe = judged.where("problem IS NOT NULL").select("archive", F.col("name").alias("member"), "problem")
    found = _kept(digests(spark, path, limits, required))
    texts = _kept(lines(spark, path, limits, required, suffix="manifest.json").unionByName(lines(spark, path, limits, required, suffix="checksums.txt")).where("problem IS NULL"))
    whole = texts.where("member = 'manifest.json'").groupBy("archive").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))  # one document
    kind = "schema_version int, files array<struct<path: string, size_bytes: long, sha256: string>>"
    manifest = whole.select("archive", F.from_json("text", kind).alias("m"))
    newer = manifest.where(F.col("m.schema_version").isNull() | F.col("m.files").isNull() | (F.col("m.schema_version") > known)).select("archive", F.lit("manifest.json").alias("member"), F.when(F.col("m.schema_version") > known, "newer layout").otherwise("not a manifest").alias("problem"))
    said = manifest.select("archive", F.explode("m.files").alias("f")).select("archive", F.col("f.path").alias("member"), F.col("f.size_bytes").alias("said_bytes"), F.col("f.sha256").alias("said_sha256"), F.lit(True).alias("said"))
    sums = texts.where("member = 'checksums.txt'").select("archive", F.substring_index("text", "  ", 1).alias("sum"), F.expr("substring(text, instr(text, '  ') + 2)").alias("member"))
    both = found.join(said, ["archive", "member"], "full_outer").join(sums, ["archive", "member"], "full_outer")
    own = F.col("member").isin(*required)
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("bytes").isNull(), "not there").when(F.col("member") == "checksums.txt", None).when(~own & F.col("said").isNull(), "not in the manifest").when(F.col("sum").isNull(), "not in the checksums")
        .when(F.col("sum") != F.col("sha256"), "other checksum").when(~own & (F.col("said_bytes") != F.col("bytes")), "other size").when(~own & (F.col("said_sha256") != F.col("sha256")), "other digest")
    )
    return unsafe.unionByName(newer).unionByName(both.select("archive", "member", problem.alias("problem")).where("problem IS NOT NULL"))
