"""Result documents of external tools, manifest lists, packs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import partial_day

EXPORT = (
    "format string, status string, program struct<name:string,language:string,compiler:string,image_base:long,executable_sha256:string,error_bookmarks:int,blocks:array<struct<name:string,start:long,size:long,execute:boolean,initialized:boolean>>>, "
    "functions array<struct<entry:long,name:string,name_source:string,size:long,thunk:boolean,section:string,blocks:array<struct<start:long,size:long,succ:array<long>>>,insns:array<array<string>>,calls:array<long>,imports:array<string>,strings:array<string>,constants:array<string>>>, "
    "counts struct<functions:long,instructions:long>"
)
#: What a correlator of the first matcher looks at.
CORRELATORS = {"ExactBytes": ["instruction"], "ExactInstructions": ["instruction"], "ExactMnemonics": ["instruction"], "SymbolsHash": ["identity"], "BulkInstructions": ["instruction", "cfg"], "StructuralGraph": ["cfg"], "CallGraph": ["callgraph"]}


def exports(spark: SparkSession, path: str) -> DataFrame:
    """Disassembly exports, one file each, with problem: null for a valid one.

    Constants are unsigned 64-bit numbers and stay text. An export counts if it is complete, names
    its subject by digest and has as many functions as it says.
    """
    own = spark.read.schema(EXPORT).option("multiLine", "true").json(path).withColumn("component", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    problem = (
        F.when(F.col("program").isNull() | F.col("functions").isNull(), "not an export").when(F.col("status") != "complete", "incomplete").when(~F.coalesce(F.col("program.executable_sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"), "no subject")
        .when(F.col("counts.functions") != F.size("functions"), "count differs")
    )
    return own.withColumn("problem", problem)


def exported_functions(valid: DataFrame) -> DataFrame:
    return valid.where("problem IS NULL").select("component", F.explode("functions").alias("f")).select("component", "f.*")


def similarity_decision(similarity: Column, confidence: Column | None = None) -> Column:
    """A matcher's similarity as a decision; a low confidence cannot be more than AMBIGUOUS."""
    out = F.when(similarity >= 0.999, "EXACT").when(similarity >= 0.9, "STRONG").when(similarity >= 0.5, "PROBABLE").otherwise("UNRESOLVED")
    return out if confidence is None else F.when((confidence < 0.5) & out.isin("EXACT", "STRONG", "PROBABLE"), "AMBIGUOUS").otherwise(out)


def matcher_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a matcher's address map: {left hex: {right, correlators}} -> left, right, families."""
    kind = "matches map<string, struct<right: string, correlators: array<string>>>"
    own = spark.read.schema(kind).option("multiLine", "true").json(path)
    address = lambda c: F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("long")
    table = F.create_map(*(x for k, v in CORRELATORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    families = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("m.value.correlators", lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull()))))
    return own.select(F.explode(F.map_entries("matches")).alias("m")).select(address(F.col("m.key")).alias("left"), address(F.col("m.value.right")).alias("right"), families.alias("families"))


def manifest_list(lines: DataFrame) -> DataFrame:
    """(id, day, precision) of lists in free text (source, pos, line): a date holds for the next id.

    Ids have 15 to 20 digits; dates are YYYY-MM-DD, DD.MM.YYYY or D Month YYYY. Of an id that repeats,
    the first line counts. Newest first.
    """
    iso = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1)
    dotted = F.regexp_replace(F.regexp_extract("line", r"(\d{2}\.\d{2}\.\d{4})", 1), r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    spelt = F.regexp_extract("line", r"(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})", 1)
    day = F.coalesce(F.try_to_date(F.nullif(iso, F.lit(""))), F.try_to_date(F.nullif(dotted, F.lit(""))), F.to_date(F.try_to_timestamp(F.nullif(spelt, F.lit("")), F.lit("d MMMM yyyy"))))
    ids = lines.withColumn("day", day).withColumn("id", F.nullif(F.regexp_extract("line", r"(?<!\d)(\d{15,20})(?!\d)", 1), F.lit("")))
    order = Window.partitionBy("source").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a date given on a line without an id waits for the next id, and is spent there
    spent = F.sum(F.when(F.col("id").isNotNull(), 1).otherwise(0)).over(before)
    ids = ids.withColumn("_spent", F.coalesce(spent, F.lit(0)))
    waiting = F.last("day", ignorenulls=True).over(Window.partitionBy("source", "_spent").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = ids.withColumn("day", waiting).where("id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("source", "id").orderBy("pos"))).where("_n = 1")
    return out.select("source", "id", "day", F.when(F.col("day").isNull(), "UNKNOWN").otherwise("DAY").alias("precision")).orderBy("source", F.desc_nulls_last("day"), "id")


def external_timestamp(text: Column) -> Column:
    """value and precision of an outside date; nothing is added to what was given."""
    precision = (
        F.when(text.rlike(r"^\d{4}$"), "YEAR").when(text.rlike(r"^\d{4}-\d{2}$"), "MONTH").when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "DAY")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), "SECOND").otherwise("UNKNOWN")
    )
    return F.struct(F.when(precision != "UNKNOWN", text).alias("value"), precision.alias("precision"), F.when(precision != "UNKNOWN", partial_day(text)).alias("day"))


def write_pack(tables: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """Each table as JSON lines in the text order of its key, and a manifest with digests.

    Rows are sorted over all partitions and written as they come, so a table of any size stays
    distributed. A table's digest is the sum of 64-bit hashes of its lines: it finds rows that were lost,
    doubled or damaged, and is no proof against somebody who forges them.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    manifest = None
    for name, (df, key) in sorted(tables.items()):
        lines = df.orderBy(F.col(key).cast("string")).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{name}")
        one = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("v")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).cast("string").alias("digest"))
        one = one.select(F.lit(name).alias("table"), "rows", "digest")
        manifest = one if manifest is None else manifest.unionByName(one)
    if manifest is not None and spark is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_pack(spark: SparkSession, path: str, name: str, schema: str, known: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A table of a pack; rows whose key is known already are left out. Raises if its digest differs."""
    df = spark.read.schema(schema).json(f"{path}/{name}")
    want = spark.read.json(f"{path}/manifest").where(F.col("table") == name).first()
    got = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("v")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).cast("string").alias("digest")).first()
    if want is None or (want["rows"], want.asDict().get("digest")) != (got["rows"], got["digest"]):
        raise ValueError(f"table {name} is not what the manifest says")
    return df if known is None else df.join(known.select(key), key, "left_anti")


def report_markdown(rows: DataFrame, title: str, most: int = 10_000) -> str:
    """A report table as Markdown, its rows in order of their text. A table with more than `most` rows shows the first
    ones and says how many there are; write_csv() writes all of any number."""
    got = rows.orderBy(*(F.col(c).cast("string") for c in rows.columns)).limit(most + 1).collect()
    more = f"\n{rows.count()} rows in all; the first {most} are shown.\n" if len(got) > most else ""
    got = got[:most]
    line = lambda cells: "| " + " | ".join("UNKNOWN" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line("---" for _ in rows.columns), *(line(r) for r in got)]) + "\n" + more


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
