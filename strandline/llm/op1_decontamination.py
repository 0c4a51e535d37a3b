"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `ngram` consecutive words of a benchmark item, or the whole of a shorter item. The
fingerprint of a window of L words is the least of the hashes of its k-grams (k = 5 at most, so
L - k + 1 k-grams: the winnowing window). A document keeps, for every stretch of L words, the
least k-gram hash with its position. A stretch equal to a benchmark window has the same k-grams
and so the same least hash: every shared span of L words or more meets in the join, for certain.
Hits are extended to the stretches around them and confirmed by comparing the words themselves.

Hash and position of a k-gram share a long: 34 bits of hash above 30 of position. A string of
2 GB has fewer than 2^30 words, so no text is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small, table

#: The characters that are not in [\x00-\x2F\x3A-\x60\x7B-\x7F], named one by one: Java takes sixteen
#: times as long for the negated class.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 5
POS_BITS = 30
HASH_MASK = (1 << 34) - 1
POS_MASK = (1 << POS_BITS) - 1
#: Checked before broadcasting benchmark windows (about 100 bytes a row) or candidates (about 100).
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else.

    lower() does the same, and faster, where every other character is one that it leaves alone.
    """
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _packed(hashes: Column, length: int) -> Column:
    """For each k-gram of the words, from the hashes of these: its own hash above its position."""
    k = min(K, length)

    def one(i: Column) -> Column:
        h = F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k))).bitwiseAND(F.lit(HASH_MASK))
        return F.shiftleft(h, POS_BITS).bitwiseOR(i.cast("long"))

    n = F.size(hashes)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(rows: DataFrame, length: int) -> DataFrame:
    """rows (doc_id, _key, _hs) -> doc_id, _key and _p: the least k-gram of every stretch of `length` words, each once.

    The least of a stretch is that of two shorter ones that cover it, so widths double. Every step is
    a projection of its own that reads the one before more than once: inside a lambda it would be
    computed again for each element.
    """
    keys = ["doc_id", "_key"]
    rows = rows.select(*keys, _packed(F.col("_hs"), length).alias("_p"))
    width, have = length - min(K, length) + 1, 1
    while have < width:
        step = min(have, width - have)
        least = F.transform(F.slice("_p", 1, F.greatest(F.lit(0), F.size("_p") - step)), lambda x, i: F.least(x, F.get("_p", i + step)))  # noqa: B023
        rows = rows.select(*keys, least.alias("_p"))
        have += step
    # a k-gram is the least of neighbouring stretches only
    return rows.select(*keys, F.filter("_p", lambda x, i: (i == 0) | (x != F.get("_p", i - 1))).alias("_p"))


def benchmark_windows(items: DataFrame, ngram: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every distinct window: its words, length, fingerprint and the items that have it."""
    own = items.select(F.col(id_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_ws")).where(F.size("_ws") > 0)
    own = own.withColumn("_len", F.least(F.size("_ws"), F.lit(ngram)))
    cut = own.select("_item", "_len", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("_ws") - F.col("_len") + 1), lambda i: F.slice("_ws", i, F.col("_len")))).alias("_win"))
    return cut.groupBy("_win", "_len").agg(F.collect_set("_item").alias("_items"))


def _fingerprinted(windows: DataFrame, lengths: list[int]) -> DataFrame:
    rows = windows.select("_win", "_len", "_items", F.transform("_win", lambda w: F.xxhash64(w)).alias("_hs"))
    mark = F.lit(None).cast("long")
    for length in lengths:
        least = F.array_min(_packed(F.col("_hs"), length))
        mark = F.when(F.col("_len") == length, F.shiftrightunsigned(least, POS_BITS)).otherwise(mark)
    return rows.select(F.array_join("_win", " ").alias("_window"), "_len", "_items", mark.alias("_fp"))


def decontaminate(docs: DataFrame, items: DataFrame, ngram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, item_ids (sorted), spans of hit words, contaminated.

    A word inside any occurrence of a benchmark window is hit. Null and empty texts have no words;
    items without words have no window, so an empty benchmark leaves every document clean. Repeated
    items count once, repeated documents each get the row. Null ids stay as they are (a null item id
    has no name to report: its windows hit, but it is not counted). Other columns are ignored.
    """
    raw = benchmark_windows(items, ngram)
    lengths = sorted(r[0] for r in raw.select("_len").distinct().collect())  # ngram values at most
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = own.withColumn("_key", F.sha2("_text", 256))
    base = own.select("doc_id", "_key", F.regexp_count(ascii_lower(F.col("_text")), F.lit(WORD)).cast("long").alias("n_words"))
    if not lengths:
        return _finished(base, None)
    windows = checkpointed(_fingerprinted(raw, lengths))
    marks = small(windows.select("_len", "_fp").distinct(), BROADCAST_ROWS)

    # 1. winnow the documents; ids and positions only leave this stage. explode_outer, because for
    # explode() the optimizer infers a filter that would repeat the array expressions inside lambdas.
    hashes = own.select("doc_id", "_key", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_hs"))
    marked = None
    for n in lengths:
        one = _winnowed(hashes, n).select("doc_id", "_key", F.explode_outer("_p").alias("_at")).withColumn("_len", F.lit(n))
        marked = one if marked is None else marked.unionByName(one)
    marked = marked.withColumn("_fp", F.shiftrightunsigned("_at", POS_BITS))
    hits = marked.join(marks, ["_len", "_fp"]).groupBy("doc_id", "_key").agg(
        F.collect_set(F.struct("_len", F.col("_at").bitwiseAND(F.lit(POS_MASK)).cast("int").alias("pos"))).alias("_hits")
    )
    hits = checkpointed(hits.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_hits"))

    # 2. extend each hit to the stretches around it; compare their words with the windows
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    near = own.join(small(hits, BROADCAST_ROWS), same).select("doc_id", "_key", words(F.col("_text")).alias("_ws"), "_hits")

    def around(hit: Column) -> Column:
        k = F.least(hit["_len"], F.lit(K))
        first, last = F.greatest(F.lit(0), hit["pos"] - hit["_len"] + k), F.least(hit["pos"], F.size("_ws") - hit["_len"])
        return F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("s"), hit["_len"].alias("n")))

    near = near.withColumn("_starts", F.array_distinct(F.flatten(F.transform("_hits", around))))
    cut = F.transform("_starts", lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.array_join(F.slice(F.col("_ws"), x["s"] + 1, x["n"]), " ").alias("w")))
    near = near.select("doc_id", "_key", cut.alias("_cut"), F.size("_ws").alias("_size"))
    near = near.select("doc_id", "_key", F.explode_outer("_cut").alias("_c")).select("doc_id", "_key", "_c.s", "_c.n", F.col("_c.w").alias("_window"))
    exact = near.join(small(windows.select("_window", "_items"), BROADCAST_ROWS), "_window")
    found = exact.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("s", "n")).alias("_at"), F.collect_set("_items").alias("_items"))
    return _finished(base, found)


def _merged(at: Column) -> Column:
    """Covered spans [start, end) from sorted, overlapping stretches."""
    spans = "array<struct<s:int,e:int>>"

    def add(acc: Column, x: Column) -> Column:
        last, end = F.element_at(acc, -1), x["s"] + x["n"]
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], end).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), end.alias("e")))))

    return F.aggregate(F.array_sort(at), F.array().cast(spans), add)


def _covered(at: Column) -> Column:
    """How many words sorted, overlapping stretches cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))

    def add(acc: Column, x: Column) -> Column:
        end = x["s"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(x["s"], acc["e"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["e"], end).alias("e"))

    return F.aggregate(F.array_sort(at), zero, add, lambda acc: acc["n"])


def _finished(base: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        out = base.select("doc_id", "n_words", F.array().cast("array<struct<s:int,n:int>>").alias("_at"), F.array().cast("array<string>").alias("item_ids"))
    else:
        ids = F.array_sort(F.array_distinct(F.flatten("_items")))
        found = found.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_at", ids.alias("item_ids"))
        out = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["_key"] == found["_k"]), "left")
        out = out.select("doc_id", "n_words", F.coalesce("_at", F.array().cast("array<struct<s:int,n:int>>")).alias("_at"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select(
        "doc_id", "n_words", _covered(F.col("_at")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        _runs(F.col("_at")).alias("spans"), (F.size("_at") > 0).alias("contaminated"),
    )


def _runs(at: Column) -> Column:
    return F.when(F.size(at) > 0, _merged(at)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bl, unnest(range(1, len(ws) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s.n, i, array_to_string(ws[i:i + s.n - 1], ' ') AS win FROM d, sizes s, unnest(range(1, len(ws) - s.n + 2)) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(0, n)) AS t(o) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
