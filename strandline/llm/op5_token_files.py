"""Token-id output: documents in ascending id order, as blocks of a static rANS.

1. Texts are dealt to ranges of doc_id, sorted, encoded with the tokenizers library and written as
   plain ids, each with its place in its range. The library sees every distinct chunk
   (bpe.TextCutter) of a slice of texts once; ids are those of the whole text.
2. All ids are counted on the way; the counts, one for each id of the vocabulary, make the shared table.
3. Runs of whole documents of about BLOCK ids become independent blocks (rans.py): a row of a
   Parquet folder with the payload, the documents' ids and sizes, and CRCs of payload and ids.
4. A reader decodes any block on its own, checks both CRCs, and finds the place of a block in the
   whole stream from the sums of the ranges before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .bpe import TextCutter, with_odd
from .common import freeing, shared_dir, staged, table
from .op2_bpe import _runs, _slices, vocabulary_path

END = 0
BLOCK = 131_072
#: Bytes of text that are encoded together, about; the library sees the distinct chunks among them once.
SLICE = 20_000_000
BLOCKS = (
    "part int, first long, offset long, n_ids long, doc_ids array<bigint>, sizes array<int>, payload binary, payload_crc32 long, ids_crc32 long"
)


class LibraryEncoder:
    """Ids by the tokenizers library; each distinct chunk of a slice of texts goes to it once."""

    #: Characters that go to the library as one text, about.
    RUN = 4_096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)  # byte-level: a letter for each byte
        self.cutter = TextCutter(self._learned)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [np.empty(0, np.int32)]
        for k in range(0, len(texts), 100):  # the library's results are some hundred bytes a token
            out += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts[k : k + 100], add_special_tokens=False)]
        return np.fromiter(map(len, out[1:]), np.int64, len(texts)), np.concatenate(out)

    def _learned(self, words: pa.StringArray, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words with a space in front and of other strings, one after the other.

        Words without white space at an end go to the library side by side: it parts them before their
        spaces. Their ends are found by the bytes that ids stand for, so that each need not be encoded,
        or become a Python string, by itself.
        """
        apart = pc.match_substring_regex(words, f"^$|^[{TextCutter._SPACE}]|[{TextCutter._SPACE}]$").to_numpy(zero_copy_only=False).astype(bool)
        joined = words.filter(pa.array(~apart))
        length = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(length), np.arange(0, length.sum(), self.RUN)), len(joined))).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), joined), " ").to_pylist() if len(joined) else []
        _, ids = self._encoded([" " + r for r in runs])
        reached, ends = np.cumsum(self.bytes[ids]), np.cumsum(length)
        at = np.searchsorted(reached, ends)
        if len(ends) and (at[-1] >= len(ids) or (reached[at] != ends).any()):
            raise ValueError("the library did not part words before their spaces")
        own_sizes, own = self._encoded([" " + w for w in words.filter(pa.array(apart)).to_pylist()] + others)
        alone = np.concatenate([apart, np.ones(len(others), bool)])
        sizes = np.empty(len(alone), np.int64)
        sizes[alone], sizes[~alone] = own_sizes, np.diff(np.concatenate([[0], at + 1]))
        out, of_alone = np.empty(int(sizes.sum()), np.int32), np.repeat(alone, sizes)
        out[of_alone], out[~of_alone] = own, ids
        return sizes, out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text begins and the end of all.

        A text that spells out an added token is cut by the library itself.
        """
        odd = np.zeros(len(texts), bool)
        for word in self.added:
            odd |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False).astype(bool)
        ids, bounds = self.cutter.encode(texts, odd)
        return with_odd(ids, bounds, {int(i): self._encoded([texts[int(i)].as_py()])[1] for i in np.flatnonzero(odd)})


_COUNTS = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
_held: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _held:
        _held[path] = LibraryEncoder(path)
    return _held[path]


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Rows (part, row, offset, doc_id, ids, counts) in id order within each part; parts ascend too.

    row counts a part's rows, offset its ids before the row. ids: little-endian uint16 where the
    vocabulary fits, else uint32, the end id last. A part ends with a row -1 that holds nothing but
    how often it has each id.
    """
    path = vocabulary or vocabulary_path()
    names = ["row", "offset", "doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, offset = _encoder(path), 0, 0
        kind = np.uint16 if encoder.size <= 1 << 16 else np.uint32
        total = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for part in _slices(batch, SLICE):
                flat, ends = encoder.encode(part.column(1))
                n = part.num_rows
                flat, ends = np.insert(flat.astype(kind), ends[1:], end), ends + np.arange(n + 1)  # the end id after each
                total += np.bincount(flat, minlength=encoder.size)
                raw = flat.tobytes()
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                columns = [pa.array(np.arange(row, row + n)), pa.array(offset + ends[:-1]), part.column(0), ids, pa.nulls(n, _COUNTS)]
                whole = pa.RecordBatch.from_arrays(columns, names)
                for a, b in _runs(ends):
                    yield whole.slice(a, b - a)
                row, offset = row + n, offset + int(ends[-1])
        seen = np.flatnonzero(total)
        counts = pa.StructArray.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])
        columns = [pa.array([-1]), pa.array([offset]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), counts)]
        yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(freeing(run), "row long, offset long, doc_id long, ids binary, counts array<struct<id: bigint, n: bigint>>")
    return staged(rows.select(F.spark_partition_id().alias("part"), "*"), "ids")


def write_blocks(rows: DataFrame, path: str, size: int, block: int = BLOCK) -> None:
    """Write tokenized rows as blocks under path/blocks, and their table under path/table."""
    spark, kind = rows.sparkSession, np.dtype("<u2" if size <= 1 << 16 else "<u4").str
    pairs = rows.where("counts IS NOT NULL").select(F.explode("counts").alias("c")).select("c.id", "c.n")
    found = pairs.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most size rows
    counts = np.zeros(size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    spark.createDataFrame([(rans.SCALE, counts.tobytes())], "scale int, counts binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(counts)  # one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table(shared.value)
        held: list[tuple] = []
        n = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[4] for h in held), kind)
            payload = rans.encode(ids, coder)
            row = {
                "part": held[0][0], "first": held[0][1], "offset": held[0][2], "n_ids": len(ids), "doc_ids": [h[3] for h in held],
                "sizes": [len(h[4]) // np.dtype(kind).itemsize for h in held], "payload": payload, "payload_crc32": zlib.crc32(payload), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)

        for batch in batches:
            for one in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (n >= block or one[0] != held[-1][0] or one[1] != held[-1][1] + 1):
                    yield closed()
                    held, n = [], 0
                held.append(one)
                n += len(one[4]) // np.dtype(kind).itemsize
        if held:
            yield closed()

    rows.where("row >= 0").select("part", "row", "offset", "doc_id", "ids").mapInArrow(freeing(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("offset", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())]
)


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for.

    A payload or ids that do not have their CRC raise an error.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counts = np.frombuffer(spark.read.parquet(f"{path}/table").first()["counts"], np.int64)
    shared = spark.sparkContext.broadcast(counts)
    names = ["part", "offset", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table(shared.value)
        for batch in batches:
            for b in batch.to_pylist():
                if zlib.crc32(b["payload"]) != b["payload_crc32"]:
                    raise ValueError(f"a damaged payload in part {b['part']} at row {b['first']}")
                ids = rans.decode(b["payload"], coder).astype("<u4")
                if len(ids) != b["n_ids"] or zlib.crc32(ids.tobytes()) != b["ids_crc32"]:
                    raise ValueError(f"wrong ids in part {b['part']} at row {b['first']}")
                ends = np.cumsum([0, *b["sizes"]])
                own = [ids[x:y] for x, y in zip(ends[:-1], ends[1:])]
                columns = [
                    pa.array(np.full(len(own), b["part"], np.int32)), pa.array(b["offset"] + ends[:-1]), pa.array(b["doc_ids"], pa.int64()), pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "part int, offset long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    docs = blocks.select("part", "first", "offset", "n_ids", "doc_ids", "sizes", "payload", "payload_crc32", "ids_crc32").mapInArrow(freeing(run), kinds)
    out = docs.join(_bases(blocks), "part")
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_stretch(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows (at, ids) with the ids at places [start, end) of the whole stream, one row for each block that has some.

    Only blocks that hold a part of it are read, and of each only what follows the checkpoint before its
    part is decoded; the CRC of the payload is checked, that of all ids cannot be.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counts = np.frombuffer(spark.read.parquet(f"{path}/table").first()["counts"], np.int64)
    shared = spark.sparkContext.broadcast(counts)
    own = blocks.join(_bases(blocks), "part").select((F.col("base") + F.col("offset")).alias("at"), "n_ids", "payload", "payload_crc32").where((F.col("at") < end) & (F.col("at") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table(shared.value)
        for batch in batches:
            for b in batch.to_pylist():
                if zlib.crc32(b["payload"]) != b["payload_crc32"]:
                    raise ValueError(f"a damaged payload at {b['at']}")
                a = max(0, start - b["at"])
                ids = rans.decode(b["payload"], coder, a, min(b["n_ids"], end - b["at"])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b["at"] + a]), pa.array([ids], pa.list_(pa.int64()))], ["at", "ids"])

    return own.mapInArrow(freeing(run), "at long, ids array<bigint>")


def _bases(blocks: DataFrame) -> DataFrame:
    """part and base: the ids of all ranges before it."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range
    return sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END, block: int = BLOCK) -> None:
    """Encode whole texts and write them under path, in ascending id order.

    Null and empty texts are the end id alone. Rows without an id come first, rows that repeat one
    stand together by text. An empty table writes a table and no blocks. Other columns are ignored.
    """
    size = LibraryEncoder(vocabulary or vocabulary_path()).size
    write_blocks(tokenized(docs, id_col, text_col, vocabulary, end), path, size, block)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_blocks(spark, path)
