"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Signatures. Each document's set of hashed word shingles gives a SuperMinHash signature
   (shingles.superminhash), its band hashes and a digest of the whole set.
2. Classes. Documents with one digest have one set: the least id stands for the class, so a group
   of copies of any size is one member from here on.
3. Buckets. Members that share a band hash meet. A bucket of more than BLOCK members is dealt into
   blocks, and each pair of blocks is a task of its own; no task holds a whole hot bucket.
4. First round: each member is paired with two pivots of its bucket. Pairs are verified on the full
   sets, links give components. Second round: every pair of a bucket's members that are not in one
   component yet. A pair is put forward once, in the first band whose hash its members share, and
   only if the signatures' marks (a byte a value) agree in as many places as a linked pair's do
   (SLACK); all that are put forward are verified.

By the binomial law of MinHash a pair at the threshold of 0.85 shares none of 32 bands of 6 with a
probability of 2.7e-7 and agrees in fewer than 192 of 256 values with one of 1.1e-5; SuperMinHash's
variance is below MinHash's. Nothing else is left out: no bucket, group or number of partners is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, freeing, small, staged, table
from .components import components
from .shingles import mix, shingle_sets, superminhash

WIDTH = 5
PERCENT = 85
M, BANDS, ROWS = 256, 32, 6
#: Equal values of M that a pair needs to be verified, as a share below the threshold.
SLACK = 0.10
#: Members of a bucket that one task compares.
BLOCK = 1024
#: Members of a bucket up to which one pivot does.
FEW = 8
#: Tasks that share a hot bucket's rows while these are counted.
SALTS = 16
#: Ids broadcast at most, 16 bytes each.
BROADCAST_ROWS = 500_000


def _texts(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of slices of a batch, each of about so many bytes or one text."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, shingle_sets(data[ends[at] : ends[end]], ends[at : end + 1] - ends[at], WIDTH)
        at = end


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sets in _texts(batch, 1):
            full = [s for s in sets if len(s)]
            sig = superminhash(full, M)
            raw = mix(np.ascontiguousarray(sig).view(np.uint64))  # the same value, the same bits
            marks = (raw >> np.uint64(56)).astype(np.uint8)
            bands = np.empty((len(full), BANDS), np.uint64)
            for b in range(BANDS):
                acc = np.full(len(full), b + 1, np.uint64)
                for r in range(b * ROWS, (b + 1) * ROWS):
                    acc = mix(acc ^ raw[:, r])
                bands[:, b] = acc
            k = 0
            out: list[list] = [[], [], [], []]
            for s in sets:
                out[0].append(len(s))
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out[2].append(bands[k].view(np.int64) if len(s) else None)
                out[3].append(marks[k].tobytes() if len(s) else None)
                k += len(s) > 0
            ids = batch.column(0).slice(at, len(sets))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2).slice(at, len(sets)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())],
                ["id", "key", "n", "digest", "bands", "marks"],
            )


def _put_forward(whole: bool):
    """Pairs of each bucket part: with its pivots, or (whole) across components."""
    least = int(M * (PERCENT / 100 - SLACK))

    def of(key: tuple, own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, n, label, block, marks, bands = (own[c] for c in ("v", "n", "label", "block", "marks", "bands"))
        _, lo, hi = key
        order = np.lexsort((v, block))
        v, n, label, block, marks, bands = v[order], n[order], label[order], block[order], marks[order], bands[order]
        if not whole:
            if lo != hi:
                return v[:0], v[:0]
            rows = np.zeros(1, np.int64)
            if len(v) > FEW:  # besides the least id, the one that agrees most with the bucket's most common values
                agree = np.zeros(len(v))
                for c in range(0, M, 4):
                    count = np.bincount(marks[:, c], minlength=256)
                    agree += count[marks[:, c]]
                rows = np.unique([0, int(agree.argmax())])
        else:
            rows = np.arange(len(v))
        got: list[tuple[np.ndarray, np.ndarray]] = []
        band = own["band"][0]
        step = max(1, 4_000_000 // (max(1, len(v)) * M))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            ok = np.minimum(n[r][:, None], n) * 100 >= np.maximum(n[r][:, None], n) * PERCENT
            if whole:
                ok &= (label[r][:, None] != label) & (r[:, None] < np.arange(len(v)))
                if lo != hi:
                    ok &= block[r][:, None] != block
            else:
                ok &= r[:, None] != np.arange(len(v))
            i, j = np.nonzero(ok)
            for a in range(0, len(i), 20_000):
                x, y = r[i[a : a + 20_000]], j[a : a + 20_000]
                keep = (marks[x] == marks[y]).sum(1) >= least
                x, y = x[keep], y[keep]
                first = ~(bands[x, :band] == bands[y, :band]).any(1)  # by the hashes that make buckets: marks can agree where bands do not
                got.append((v[x[first]], v[y[first]]))
        if not got:
            return v[:0], v[:0]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, 3):
            t = pa.Table.from_batches(rows)
            own = {c: t.column(c).to_numpy() for c in ("v", "n", "label", "block", "band")}
            own["marks"] = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, M)
            own["bands"] = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            a, b = of(key, own)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same leading columns, across batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text) sorted by a with a's own text (b null) first -> linked pairs (a, b)."""
    own_id, own = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: tuple[list, list] = ([], [])
        for at, sets in _texts(batch, 2):
            for k, s in enumerate(sets, at):
                if b[k] is None:
                    own_id, own = a[k], s
                elif own_id == a[k] and len(s) and len(own):
                    at_own = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    both = int((own[at_own] == s).sum())
                    if 100 * both >= PERCENT * (len(own) + len(s) - both):
                        out[0].append(a[k])
                        out[1].append(b[k])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs whose full sets are as similar as the threshold asks."""
    odd = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 1  # either end may be a hub: half its pairs each
    turned = pairs.select(F.when(odd, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("b"))
    turned = checkpointed(turned.distinct())
    other = turned.join(texts, turned["b"] == texts["v"]).select("a", "b", "text")
    first = texts.join(turned.select(F.col("a").alias("v")).distinct(), "v").select(F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = first.unionByName(other).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return checkpointed(rows.mapInArrow(freeing(_verified), "a long, b long"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Words stand between ASCII white space, A-Z count as a-z; a set holds the distinct runs of five
    words, or the whole of a shorter text. Documents are linked when 100 * intersection is at least
    85 * union; component_id is the least id that links reach. Null, empty and white texts have no
    shingles and are linked with nothing. Rows that repeat an id name one vertex; if their texts
    differ, the one with the least digest of its set is compared with others. A row without an id takes
    its component from rows with the same set, or null, and is kept only if that is null. Ids are whole
    numbers; one that is none raises an error. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    signed = staged(own.mapInArrow(freeing(_signed), "id long, key long, n long, digest binary, bands array<bigint>, marks binary"), "signatures")
    classes = checkpointed(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("v")))

    named = classes.where("v IS NOT NULL")
    chosen = signed.select(F.col("id").alias("v"), "digest", "key").join(named, ["v", "digest"], "left_semi").groupBy("v").agg(F.min(F.struct("digest", "key")).alias("_c")).select("v", "_c.digest", "_c.key")
    members = signed.select(F.col("id").alias("v"), "digest", "key", "n", "bands", "marks").join(chosen, ["v", "digest", "key"], "left_semi").dropDuplicates(["v"])
    members = staged(members.drop("digest"), "members")
    # a bucket's rows are dealt to salts, and its size goes to those of them that it has: no task gets all rows of a hot one
    spread = members.select("v", F.posexplode("bands").alias("band", "h")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    counted = spread.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("_x"), F.max("v").alias("_y"), F.bit_or(bit).alias("_bits")).where("_x < _y")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col("_bits"), k) == 1)
    counted = counted.select("h", "c", F.explode(salts).alias("salt"))
    crowded = checkpointed(spread.join(counted, ["h", "salt"]).select("h", "band", "v", "c"))

    ids = crowded.select("v").distinct()
    few = small(members.join(ids, "v", "left_semi").select(F.col("v").alias("id"), "key"), BROADCAST_ROWS)
    texts = own.join(few, ["id", "key"], "left_semi").select(F.col("id").alias("v"), "text").dropDuplicates(["v"])
    texts = staged(texts, "candidates")
    marks = members.join(ids, "v", "left_semi").select("v", "n", "marks", "bands")

    def pairs(rows: DataFrame, whole: bool) -> DataFrame:
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1) if whole else F.array("block")))
        rows = rows.join(marks, "v").select("h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "v", "n", "label", "block", "band", "marks", "bands")
        dealt = rows.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
        return dealt.mapInArrow(freeing(_put_forward(whole)), "a long, b long")

    links = _links(pairs(crowded.withColumn("label", F.col("v")), False), texts)
    labels = checkpointed(components(links))
    labelled = crowded.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    open_ = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    more = _links(pairs(labelled.join(open_, "h", "left_semi"), True), texts)
    labels = components(links.unionByName(more))

    of_class = classes.join(labels, "v", "left").select("digest", F.coalesce("label", "v").alias("component"))
    back = signed.select(F.col("id"), "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = back.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
