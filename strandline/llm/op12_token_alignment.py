"""Alignment of two tokenizers: a sweep over the ends of their tokens.

1. Each text is encoded by both; where the bytes of a side's tokens are not those of the text with a
   space in front, the document has no tokens. What leaves is the union of A's and B's end events,
   packed: the ids of a side whose ends lie in one stretch of a document, and the stretch's offset. A
   token's end follows from the sizes of the tokens before it.
2. Events are dealt by document and sorted by offset in each partition. The sweep reads them as they
   come; of the document that is open it holds a running digest, counts, and the tokens since the last
   offset at which both sides end. Each such offset closes a group, and links the two tokens that end
   there.
3. The links of all documents are counted by pair of ids, first in each task, then by Spark; the
   counts go back to the documents in passes of a bounded number of pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TextCutter, _byte_letters, with_odd
from .common import freeing, small, staged, table
from .op2_bpe import _slices, vocabulary_path
from .op5_token_files import LibraryEncoder

A, B, NONE = 0, 1, 2
#: Bytes of a document that one event row covers.
STRETCH = 1 << 16
#: Bytes of text that are encoded together, and tokens that are swept together, about.
SLICE, SWEEP = 8_000_000, 1_000_000
#: Pairs whose counts one pass takes to the documents, and pairs that a task counts before it passes them on.
PAIRS, HELD = 2_000_000, 1_000_000
EVENTS = "key long, doc_id {kind}, offset long, side int, ids binary"
SWEPT = "key long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, times binary, pairs array<struct<code: bigint, n: bigint>>"
_PAIRS = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))


def piece_path() -> str:
    return os.path.join(os.path.dirname(vocabulary_path()), "piece_bpe_32k.model")


class PlainEncoder(LibraryEncoder):
    """Byte-level ids; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []
        letters = {c: b for b, c in _byte_letters().items()}
        self.tokens = [b""] * self.size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


class PieceEncoder:
    """Ids of a sentencepiece model; each distinct word of a slice of texts goes to it once.

    A piece of the model holds the mark of a space only at its front, so no merge crosses the place
    before a space that follows another character: words between single spaces are encoded apart.
    Texts with other spaces, or with the mark itself, are encoded whole, as are all of them if the
    model is of another kind.
    """

    MARK = "▁"
    #: Characters that go to the library as one text, about.
    RUN = 4_096

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(names)]
        self.starts = np.array([p.startswith(self.MARK) for p in names])
        probe = " two  spaces 　ﬁ "
        self.apart = all(self.MARK not in p.lstrip(self.MARK) for p in names) and b"".join(self.tokens[i] for i in self.model.encode(probe)) == f" {probe}".encode()
        self.cutter = TextCutter(self._learned)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x, np.int32) for k in range(0, len(texts), 200) for x in self.model.encode(texts[k : k + 200], num_threads=1)]
        return np.fromiter(map(len, got), np.int64, len(texts)), np.concatenate([np.empty(0, np.int32), *got])

    def _learned(self, words: pa.StringArray, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words and other strings, one after the other. Words go to the library side by
        side; each begins with the only piece that has the mark."""
        length = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = np.unique(np.append(np.searchsorted(length, np.arange(0, length[-1] if len(words) else 0, self.RUN)), len(words))).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist() if len(words) else []
        _, ids = self._encoded(runs)
        begins = np.flatnonzero(self.starts[ids])
        if len(begins) != len(words):
            raise ValueError("the library did not part words before their spaces")
        sizes, own = self._encoded(others)
        return np.concatenate([np.diff(np.append(begins, len(ids))), sizes]), np.concatenate([ids, own])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text begins and the end of all."""
        space = TextCutter._SPACE
        odd = pc.match_substring_regex(texts, f"^$|^ | $| [{space}]|[{space}] |{self.MARK}").to_numpy(zero_copy_only=False).astype(bool)
        if not self.apart:
            odd[:] = True
        ids, bounds = self.cutter.encode(texts, odd)
        at = np.flatnonzero(odd)
        sizes, own = self._encoded(texts.take(pa.array(at)).to_pylist())
        return with_odd(ids, bounds, {int(i): x for i, x in zip(at, np.split(own, np.cumsum(sizes)[:-1]))} if len(at) else {})


_held: dict[tuple[str, str], tuple[PlainEncoder, PieceEncoder]] = {}


def _encoders(a: str, b: str) -> tuple[PlainEncoder, PieceEncoder]:
    if (a, b) not in _held:
        _held[a, b] = PlainEncoder(a), PieceEncoder(b)
    return _held[a, b]


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _bytes_at(ids: np.ndarray, tokens: pa.Array) -> np.ndarray:
    """The bytes of tokens, one after the other."""
    taken = tokens.take(pa.array(ids))
    return np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: int(pc.sum(pc.binary_length(taken)).as_py() or 0)]


def _spelt(ids: np.ndarray, bounds: np.ndarray, tokens: pa.Array, sizes: np.ndarray, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text, whether its tokens' bytes are its own; want: the bytes of all texts, with their ends."""
    said = _bytes_at(ids, tokens)
    if len(said) == len(want):
        reached = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds]
        if (reached == ends).all() and np.array_equal(said, want):
            return np.ones(len(bounds) - 1, bool)
    reached = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds]
    return np.array([np.array_equal(said[a:b], want[c:d]) for a, b, c, d in zip(reached[:-1], reached[1:], ends[:-1], ends[1:])], bool)


def events(docs: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """The end events of both sides, packed by stretch; a document without tokens has one row of no side.

    key tells rows apart; docs must come in the same order if a task runs again, as a scan does.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _encoders(a, b)
        spelt = [pa.array(e.tokens, pa.binary()) for e in sides]
        sizes = [np.array(list(map(len, e.tokens)), np.int64) for e in sides]
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _slices(batch, SLICE):
                n, names, texts = part.num_rows, part.column(0), part.column(1)
                spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64))])
                want = np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]]
                coded = [sides[A].encode(spaced), sides[B].encode(texts)]
                good = np.diff(ends) > 1
                for (ids, bounds), tokens, size in zip(coded, spelt, sizes):
                    good &= _spelt(ids, bounds, tokens, size, want, ends)
                bad = pa.array(np.flatnonzero(~good))
                if len(bad):
                    nothing = [pa.array(bad.to_numpy() + key), names.take(bad), pa.array(np.zeros(len(bad), np.int64)), pa.array(np.full(len(bad), NONE, np.int32)), pa.nulls(len(bad), pa.binary())]
                    yield pa.RecordBatch.from_arrays(nothing, ["key", "doc_id", "offset", "side", "ids"])
                for side, (ids, bounds), size in zip((A, B), coded, sizes):
                    yield from _packed(ids, bounds, size, good, side, key, names, _kind(len(size)))
                key += n

    return own.mapInArrow(freeing(run), EVENTS.format(kind=kind))


def _packed(ids: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, good: np.ndarray, side: int, key: int, names: pa.Array, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Rows of one side's ids, a row for each stretch of each good text."""
    reached = np.concatenate([[0], np.cumsum(sizes[ids])])
    counts = np.diff(bounds)
    of = np.repeat(np.arange(len(counts)), counts)
    stretch = (reached[1:] - reached[bounds[:-1]][of] - 1) // STRETCH
    begins = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(stretch, prepend=-1))
    lasts = np.append(begins[1:], len(ids))
    flat = ids.astype(kind)
    keep = good[of[begins]]
    rows = [(o, s, x, y) for o, s, x, y in zip(of[begins][keep], stretch[begins][keep], begins[keep], lasts[keep])]
    for k in range(0, len(rows), 2_000):
        some = rows[k : k + 2_000]
        docs = np.array([r[0] for r in some])
        columns = [
            pa.array(docs + key), names.take(pa.array(docs)), pa.array(np.array([r[1] for r in some]) * STRETCH), pa.array(np.full(len(some), side, np.int32)),
            pa.array([flat[x:y].tobytes() for _, _, x, y in some], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "offset", "side", "ids"])


class Sweep:
    """The machine that reads events in order. Of the open document it keeps a digest, counts and the tokens since the last common end."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.sizes = size_a, size_b
        self.span = len(size_b)
        self.open: tuple[int, object] | None = None  # key and id of the document that may go on
        self.reset()
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        width = len(str(max(len(size_a), len(size_b)))) + 1
        self.spelt = np.zeros((3, max(len(size_a), len(size_b)), width), np.uint8)
        for i in range(self.spelt.shape[1]):
            for s, mark in enumerate(b",|;"):
                text = str(i).encode() + bytes([mark])
                self.spelt[s, i, : len(text)] = list(text)
        self.spelt = self.spelt.reshape(-1, width)
        self.length = (self.spelt > 0).sum(1)

    def reset(self) -> None:
        self.digest, self.n = hashlib.sha256(), [0, 0, 0]
        self.left = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def closed(self) -> dict:
        """The open document's row, with no more pairs than have left already."""
        if len(self.left[A]) or len(self.left[B]):
            raise ValueError("the sides of a document end apart")
        (key, doc_id), n, digest = self.open, self.n, self.digest
        self.reset()
        return {"key": key, "doc_id": doc_id, "n_a": n[A], "n_b": n[B], "n_groups": n[2], "groups_sha256": digest.hexdigest() if n[2] else "", "codes": b"", "times": b""}

    def run(self, rows: list[tuple[int, object, int, np.ndarray]], last: bool) -> Iterator[dict]:
        """Sweep (key, doc_id, side, ids) in order; the last document stays open unless there is nothing after it."""
        if rows and self.open is not None and self.open[0] != rows[0][0]:
            yield self.closed()
            self.open = None
        docs: list[tuple[int, object]] = []
        parts: tuple[list, list] = ([], [])
        held: tuple[list, list] = ([], [])
        for key, doc_id, side, ids in rows:
            if not docs or docs[-1][0] != key:
                docs.append((key, doc_id))
                if len(docs) == 1 and self.open is not None:
                    for s in (A, B):
                        parts[s].append(self.left[s])
                        held[s].append(np.zeros(len(self.left[s]), np.int64))
            if side != NONE:
                parts[side].append(ids)
                held[side].append(np.full(len(ids), len(docs) - 1))
        if not docs:
            return
        ids = [np.concatenate([np.empty(0, np.int64), *p]) for p in parts]
        of = [np.concatenate([np.empty(0, np.int64), *h]) for h in held]
        count = len(docs)
        # places on one line, document after document
        sizes = [size[i] for size, i in zip(self.sizes, ids)]
        total = np.maximum(*(np.bincount(o, z, count).astype(np.int64) for o, z in zip(of, sizes)))
        base = np.cumsum(total) - total + np.arange(count)
        ends = []
        for o, z in zip(of, sizes):
            reached = np.cumsum(z)
            before = np.concatenate([[0], reached])[np.searchsorted(o, np.arange(count))]
            ends.append(reached - before[o] + base[o])
        at = np.searchsorted(ends[B], ends[A])
        meet = np.flatnonzero((at < len(ends[B])) & (ends[B][np.minimum(at, len(ends[B]) - 1)] == ends[A])) if len(ends[B]) else np.empty(0, np.int64)
        last_a, last_b = meet, at[meet]
        doc = of[A][last_a]  # of each group
        full = [(last_a[-1] + 1 if len(last_a) else 0), (last_b[-1] + 1 if len(last_b) else 0)]
        rest = [i[f:] for i, f in zip(ids, full)]
        if (last and (len(rest[A]) or len(rest[B]))) or any((o[f:] != count - 1).any() for o, f in zip(of, full)):
            raise ValueError("the sides of a document end apart")
        texts, cuts = self._text(ids[A][: full[A]], ids[B][: full[B]], last_a, last_b, np.searchsorted(doc, np.arange(count + 1)))
        of = [o[:f] for o, f in zip(of, full)]
        n = [np.bincount(o, minlength=count) for o in of]
        groups = np.bincount(doc, minlength=count)
        code = ids[A][last_a] * self.span + ids[B][last_b]
        pairs, times = np.unique(doc * (len(self.sizes[A]) * self.span) + code, return_counts=True)
        owner, pairs = np.divmod(pairs, len(self.sizes[A]) * self.span)
        self._count(pairs, times)
        slots = np.searchsorted(owner, np.arange(count + 1))
        kind = np.dtype("<u4" if len(self.sizes[A]) * self.span <= 1 << 32 else "<u8")
        for d, (key, doc_id) in enumerate(docs):
            said = texts[cuts[d] : cuts[d + 1]]
            if len(said):
                if self.n[2]:
                    self.digest.update(b";")
                self.digest.update(said[:-1])
            self.n = [self.n[0] + int(n[A][d]), self.n[1] + int(n[B][d]), self.n[2] + int(groups[d])]
            own = slice(slots[d], slots[d + 1])
            row = {"key": key, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""}
            links = {"codes": pairs[own].astype(kind).tobytes(), "times": times[own].astype("<u4").tobytes()}
            self.open, self.left = docs[d], [np.empty(0, np.int64)] * 2
            if d < count - 1 or last:
                row = self.closed()
            elif not links["codes"]:
                continue
            yield row | links
        self.open, self.left = (None if last else docs[-1]), rest

    def _text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups as text, each with a ; behind it, and where each document's begins."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        group_a, group_b = np.cumsum(mark_a) - mark_a, (np.cumsum(mark_b) - mark_b) // 2
        before = np.concatenate([[0], last_b + 1])  # B tokens in front of each group
        place_a, place_b = np.arange(len(a)) + before[group_a], np.arange(len(b)) + last_a[group_b] + 1
        slots = np.empty(len(a) + len(b), np.int64)
        vocabulary = len(self.spelt) // 3
        slots[place_a], slots[place_b] = mark_a * vocabulary + a, mark_b * vocabulary + b
        flat = self.spelt[slots]
        reached = np.concatenate([[0], np.cumsum(self.length[slots])])
        tokens = np.concatenate([[0], last_a + last_b + 2])  # tokens up to the end of each group
        return flat[flat > 0].tobytes(), reached[tokens[bounds]]

    def _count(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.counted.append((pairs, times))
        if sum(len(p) for p, _ in self.counted) > 2 * HELD:
            self.counted = [self.counts()]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.counted:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, at = np.unique(np.concatenate([p for p, _ in self.counted]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([t for _, t in self.counted]), len(pairs)).astype(np.int64)


def swept(found: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows of documents with their pairs, and rows of nothing but a task's pair counts."""
    kind = found.schema["doc_id"].dataType.simpleString()
    shared = found.sparkSession.sparkContext.broadcast(sizes)  # a number for each id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, kinds = Sweep(*shared.value), [_kind(len(s)) for s in shared.value]
        rows: list[tuple] = []
        n, names = 0, ["key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"]
        schema = None

        def out(got: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            some: list[dict] = []
            for row in got:
                some.append(row)
                if len(some) == 2_000:
                    yield batch_of(some)
                    some = []
            if some:
                yield batch_of(some)

        def batch_of(some: list[dict]) -> pa.RecordBatch:
            types = [pa.int64(), schema, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array([r[x] for r in some], t) for x, t in zip(names, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(some), _PAIRS)], [*names, "pairs"])

        def counts() -> Iterator[pa.RecordBatch]:
            pairs, times = machine.counts()
            machine.counted = []
            for k in range(0, len(pairs), 100_000):
                p, t = pairs[k : k + 100_000], times[k : k + 100_000]
                values = pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), pa.StructArray.from_arrays([pa.array(p), pa.array(t)], ["code", "n"]))
                columns = [pa.array([-1]), pa.nulls(1, schema), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), values]
                yield pa.RecordBatch.from_arrays(columns, [*names, "pairs"])

        for batch in batches:
            schema = batch.schema.field(1).type
            for key, doc_id, side, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                ids = None if side == NONE else np.frombuffer(raw.as_buffer(), kinds[side]).astype(np.int64)
                if n >= SWEEP and side != B:  # both sides of a stretch go together
                    yield from out(machine.run(rows, False))
                    rows, n = [], 0
                rows.append((key, doc_id, side, ids))
                n += 0 if ids is None else len(ids)
            if sum(len(p) for p, _ in machine.counted) > HELD:
                machine.counted = [machine.counts()]
                if len(machine.counted[0][0]) > HELD:
                    yield from counts()
        if rows:
            yield from out(machine.run(rows, True))
        if schema is not None:
            yield from counts()

    return found.mapInArrow(freeing(run), SWEPT.format(kind=kind))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, and the pair
    counts (a, b, n, best).

    A: byte-level ids of the text with a space in front; B: pieces of the text. Null and empty texts and
    those that a side does not spell have no tokens: zeros and an empty digest. Repeated rows each give a
    row, ids may be null and of any type, other columns are ignored whatever their names, an empty table
    gives no rows. A text of any length is aligned whole; its open group is all that must fit in memory.
    docs must be a scan, or something as repeatable.
    """
    a, b = a or vocabulary_path(), b or piece_path()
    sides = _encoders(a, b)
    sizes = tuple(np.array(list(map(len, e.tokens)), np.int64) for e in sides)
    span = len(sizes[B])
    dealt = events(docs, id_col, text_col, a, b).repartition("key").sortWithinPartitions("key", "offset", "side")
    held = staged(swept(dealt, sizes), "swept")
    counts = held.where("pairs IS NOT NULL").select(F.explode("pairs").alias("p")).groupBy(F.col("p.code").alias("code")).agg(F.sum("p.n").alias("n"))
    counts = staged(counts, "pairs").withColumn("b", F.col("code") % span)
    most = small(counts.groupBy("b").agg(F.max("n").alias("most")), span)  # a row for each id of B at most
    counts = staged(counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    n = counts.count()
    passes = max(1, -(-n // pairs))
    rows = held.where("pairs IS NULL")
    parts = [_scored(rows, counts if passes == 1 else counts.where(F.pmod(F.xxhash64("code"), F.lit(passes)) == k), sizes) for k in range(passes)]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p.select("key", "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")), F.lit("").alias("groups_sha256"), "n_best", "count_sum"))
    out = scores.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256"))
    table = counts.select(F.expr(f"code div {span}").alias("a"), (F.col("code") % span).alias("b"), "n", "best")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"), table


def _scored(rows: DataFrame, counts: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """What the links of each row count, by the pairs of one pass."""
    got = counts.toArrow()  # bounded by the pass
    code, n, best = (got[c].to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast((code[order], n[order], best[order].astype(bool)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = np.dtype("<u4" if len(sizes[A]) * len(sizes[B]) <= 1 << 32 else "<u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            raw, times = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            own = np.frombuffer(b"".join(raw), width).astype(np.int64)
            weight = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
            of = np.repeat(np.arange(len(raw)), np.fromiter((len(x) // width.itemsize for x in raw), np.int64, len(raw)))
            at = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
            known = code[at] == own if len(code) else np.zeros(len(own), bool)
            at, weight, of = at[known], weight[known], of[known]
            sums = [_summed(of, weight * best[at], len(raw)), _summed(of, weight * n[at], len(raw))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), *map(pa.array, sums)], [*batch.schema.names[:6], "n_best", "count_sum"])

    return rows.mapInArrow(freeing(run), f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")


def _summed(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by slot, without rounding."""
    out = np.zeros(n, np.int64)
    np.add.at(out, of, values)
    return out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
