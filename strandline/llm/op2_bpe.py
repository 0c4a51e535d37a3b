"""BPE encoding and decoding through a lexicon automaton.

The corpus's frequent words are counted in Spark and compiled, with their ids, into a minimal
acyclic transducer (bpe.Lexicon). Its file goes to every executor with addFile and is mapped into
memory by each worker. Words it lacks are merged exactly, many at a time. The lexicon only saves
work: ids are the same with any lexicon, and with none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, Lexicon, Vocabulary, vocabulary_at
from .common import freeing, shared_file, table

#: Of a corpus's characters, a word of the lexicon opens one in so many: with its space it takes two
#: of them at least, so there are at most half as many words; its file takes about 40 bytes a word.
ONE_IN = 1_000_000
#: Bytes of text that are encoded together, about; the distinct chunks among them are encoded once.
SLICE = 12_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_words(docs: DataFrame, one_in: int = ONE_IN, text_col: str = "text") -> list[str]:
    """The words of letters between spaces that are frequent enough, counted over all texts."""
    size = docs.agg(F.sum(F.length(F.col(text_col)).cast("long"))).first()[0] or 0
    words = docs.select(F.explode_outer(F.split(F.col(text_col), " ")).alias("w"))
    counted = words.groupBy("w").count().where((F.col("count") * one_in >= size) & F.col("w").rlike(r"^\p{L}+$"))
    return sorted(r["w"] for r in counted.collect())


def lexicon_file(spark: SparkSession, words: list[str], vocabulary: Vocabulary) -> str:
    """Compile the words, with and without a space before them, into a file of the shared folder that executors fetch."""
    forms = [x.encode() for w in words for x in (w, " " + w)]
    sizes, flat = vocabulary.merge(forms)
    ids = dict(zip(forms, np.split(flat, np.cumsum(sizes)[:-1])))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(shared_file(spark, name, Lexicon.packed(ids)))
    return name


_held: dict[tuple, Encoder] = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    """One encoder a worker, kept from task to task."""
    if (path, lexicon) not in _held:
        _held.clear()
        _held[path, lexicon] = Encoder(vocabulary_at(path), Lexicon(SparkFiles.get(lexicon)))
    return _held[path, lexicon]


def _encoded(path: str, lexicon: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, lexicon)
    for batch in batches:
        for part in _slices(batch, SLICE):
            flat, ends = encoder.encode(part.column(1))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            whole = pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])
            for a, b in _runs(ends):
                yield whole.slice(a, b - a)


def _runs(ends: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of rows with about so many elements together at most, so that batches to the JVM are small."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = vocabulary_at(path).token_bytes.__getitem__
    for batch in batches:
        texts = [b"".join(map(of, x)).decode("utf-8", "replace") for x in _lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, one_in: int = ONE_IN) -> DataFrame:
    """doc_id and ids (array of int) of each whole text.

    Null and empty texts have no ids. Special tokens spelt out in a text become their ids. Repeated
    rows each give a row, null ids stay null, other columns are ignored whatever their names, an
    empty table gives no rows. A text of any length is encoded whole.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    name = lexicon_file(spark, frequent_words(docs, one_in, text_col), vocabulary_at(path))

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(freeing(lambda batches: _encoded(path, name, batches)), f"doc_id {kind}, ids array<int>")


def _slices(batch: pa.RecordBatch, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text at most, or one longer text."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        low = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, low + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, ids and text as decode(encode(docs)) has them, by the same worker."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    name = lexicon_file(spark, frequent_words(docs, one_in, text_col), vocabulary_at(path))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(freeing(lambda batches: _decoded(path, _encoded(path, name, batches))), f"doc_id {kind}, ids array<int>, text string")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and text: the bytes of the ids, read as UTF-8 (wrong bytes become U+FFFD).

    Null ids give an empty text; special tokens are spelt out.
    """
    path = vocabulary or vocabulary_path()

    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(freeing(lambda batches: _decoded(path, batches)), f"doc_id {kind}, ids array<int>, text string")


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # offsets of a slice are its own
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b].tolist()


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))
