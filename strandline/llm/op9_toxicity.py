"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from labelled rows (whole words and
word beginnings, in any language), how close its hits stand to a second person, capitals,
punctuation, and words with digits or signs inside letters (obfuscation). Texts are featurised with
numpy over their UTF-8 bytes, many at a time.

Labels are used only from rows whose crc32(doc_id as text) mod 5 is not 0, at most `sample` of them
in the order of a hash of doc_id: remainders 1 and 2 give the lexicon, 3 the trees, 4 the calibration,
so that no label is used twice. Spark counts the lexicon's evidence; what comes to the driver is the lexicon (LEXICON
entries) and the sample's features (about 150 bytes a row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, staged, table
from .shingles import _BYTE, _FOLD, _power, mix

#: Labelled rows that train() learns from at most, a parameter of it.
SAMPLE = 30_000
#: Entries of the lexicon at most, a parameter of train(): the ones with the most evidence.
LEXICON = 4_000
PREFIXES = (4, 5, 6, 8)
SEEDS = "idiot moron stupid loser clown scum trash worthless pathetic disgusting dumb fool hate ugly shut jerk kill crap damn hell".split()
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split()
NEAR = 4
NAMES = (
    "hits hit_weight hit_max hits_log seeds seeds_log second near capitals shouted exclamations punctuation runs obfuscated digits words word_length wide hit_kinds".split()
)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _key(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return _hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def _hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    powers, inverse = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[data]] * powers[: len(data)], out=sums[1:])
        return mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))


class Words:
    """The words of many texts: runs of ASCII letters and of bytes above 127."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts, n = data, starts, len(data)
        letter = _LETTER[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True  # no word spans two texts
        head, tail = letter.copy(), letter.copy()
        head[1:] &= ~letter[:-1] | edge[1:n]
        tail[:-1] &= ~letter[1:] | edge[1:n]
        self.at, self.to = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.at, starts)
        powers, self.inverse = _power(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[_FOLD[data]] * powers[:n], out=self.sums[1:])

    def keys(self, length: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first bytes; 0 where a word is not longer than that."""
        to = self.to if length is None else np.minimum(self.at + length, self.to)
        with np.errstate(over="ignore"):
            own = mix((self.sums[to] - self.sums[self.at]) * self.inverse[self.at] + (to - self.at).astype(np.uint64))
        if length is not None:
            own[self.to - self.at <= length] = 0
            own ^= np.uint64(length)  # a beginning is another thing than the same whole word
        return own

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[self.first[1:]] - total[self.first[:-1]]).astype(float)

    def bytes_per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[self.starts[1:]] - total[self.starts[:-1]]).astype(float)


_SEED_KEYS = None


def features(data: np.ndarray, starts: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text. keys (sorted) and weights: the learned lexicon."""
    global _SEED_KEYS
    if _SEED_KEYS is None:
        _SEED_KEYS = np.sort([_key(w) for w in SEEDS]), np.sort([_key(w) for w in SECOND])
    seeds, second = _SEED_KEYS
    w = Words(data, starts)
    whole = w.keys()
    weight = _looked_up(whole, keys, weights)
    for length in PREFIXES:
        weight = np.maximum(weight, _looked_up(w.keys(length), keys, weights))
    hit, seed, you = weight > 0, np.isin(whole, seeds), np.isin(whole, second)
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(w.first))
    spots = np.flatnonzero(you)
    near = np.zeros(len(whole), bool)
    marked = np.flatnonzero(hit | seed)
    if len(spots) and len(marked):
        after = np.searchsorted(spots, marked)
        for side in (np.maximum(after - 1, 0), np.minimum(after, len(spots) - 1)):
            p = spots[side]
            near[marked] |= (np.abs(p - marked) <= NEAR) & (text_of[p] == text_of[marked])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    long_word = w.to - w.at
    shouted = (upper[w.to] - upper[w.at] == long_word) & (long_word > 1)
    punct, letter = _PUNCT[data], _LETTER[data]
    run = punct.copy()
    run[1:] &= punct[:-1]
    run[:1] = False
    odd = (_DIGIT[data] | punct) & ~np.isin(data, np.frombuffer(b"'-.", np.uint8))
    inside = odd.copy()
    inside[1:] &= letter[:-1]
    inside[:-1] &= letter[1:]
    inside[:1] = inside[-1:] = False
    n = np.maximum(1.0, w.per_text(np.ones(len(whole), bool)))
    size = np.maximum(1.0, np.diff(starts).astype(float))
    top = np.zeros(len(starts) - 1)
    if len(whole):
        np.maximum.at(top, text_of, weight)
    kinds = np.zeros(len(starts) - 1)
    where = np.flatnonzero(hit)
    if len(where):
        pairs = np.unique(np.stack([text_of[where].astype(np.uint64), whole[where]]), axis=1)
        np.add.at(kinds, pairs[0].astype(np.int64), 1)
    hits, seed_n = w.per_text(hit), w.per_text(seed)
    return np.stack(
        [
            hits / n, w.per_text(weight) / n, top, np.log1p(hits), seed_n / n, np.log1p(seed_n), w.per_text(you) / n, w.per_text(near) / n,
            w.bytes_per_text(_UPPER[data]) / size, w.per_text(shouted) / n, w.bytes_per_text(data == 33) / size, w.bytes_per_text(punct) / size, w.bytes_per_text(run) / size,
            w.bytes_per_text(inside) / n, w.bytes_per_text(_DIGIT[data]) / size, np.log1p(n), w.per_text(long_word) / n, w.bytes_per_text(data > 127) / size, np.log1p(kinds),
        ],
        axis=1,
    )


def _looked_up(own: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(own))
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, weights[at], 0.0)


class Trees:
    """Boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.12, bins: int = 48, penalty: float = 3.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[list, np.ndarray]] = []
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            splits, leaves, at = self._tree(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append((splits, leaves))
            raw += leaves[at]
        return self

    def _tree(self, binned, grad, hess):
        at, splits = np.zeros(len(grad), np.int64), []
        for level in range(self.depth):
            nodes = 1 << level
            best = [(0.0, 0, self.bins)] * nodes  # a split that sends all rows left
            g_all, h_all = np.bincount(at, grad, nodes), np.bincount(at, hess, nodes)
            parent = g_all**2 / (h_all + self.penalty)
            for f in range(binned.shape[1]):
                code = at * (self.bins + 1) + binned[:, f]
                g = np.cumsum(np.bincount(code, grad, nodes * (self.bins + 1)).reshape(nodes, -1), 1)
                h = np.cumsum(np.bincount(code, hess, nodes * (self.bins + 1)).reshape(nodes, -1), 1)
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + self.penalty) + gr**2 / (hr + self.penalty) - parent[:, None]
                gain[(h < self.least) | (hr < self.least)] = 0
                k = gain.argmax(1)
                for node in range(nodes):
                    if gain[node, k[node]] > best[node][0] + 1e-9:
                        best[node] = (float(gain[node, k[node]]), f, int(k[node]))
            splits.append([(f, k) for _, f, k in best])
            at = self._down(binned, at, splits[-1])
        leaves = self.rate * np.bincount(at, grad, 1 << self.depth) / (np.bincount(at, hess, 1 << self.depth) + self.penalty)
        return splits, leaves, at

    @staticmethod
    def _down(binned, at, splits):
        f, k = np.array(splits).T
        return at * 2 + (binned[np.arange(len(at)), f[at]] > k[at])

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in splits:
                at = self._down(binned, at, level)
            out += leaves[at]
        return out


class Isotonic:
    """The best rising step function from raw scores to shares, by pooling adjacent violators.

    Each block's share is drawn half an observation towards the overall share, so no score is
    certain, and scores between blocks are interpolated.
    """

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum, count, sum of raw
        for r, v in zip(raw[order], y[order]):
            blocks.append([float(v), 1.0, float(r)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, t = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
        prior = float(y.mean()) if len(y) else 0.5
        self.x = np.array([t / n for _, n, t in blocks])
        self.y = np.maximum.accumulate([(s + 0.5 * prior) / (n + 0.5) for s, n, _ in blocks])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


class Model:
    """Lexicon, trees and calibration; without both labels among the rows, the share of toxic ones."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights, self.trees, self.share = keys, weights, None, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Model:
        self.share = float(y.mean()) if len(y) else 0.0
        fit, check = part == 3, part == 4
        if not 0 < y[fit].sum() < fit.sum():
            fit = np.ones(len(y), bool)  # too few rows to set some apart
        if 0 < y[fit].sum() < fit.sum():
            self.trees = Trees().fit(x[fit], y[fit])
            if not 0 < y[check].sum() < check.sum():
                check = fit
            self.calibrated = Isotonic().fit(self.trees.raw(x[check]), y[check])
        return self

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(starts) - 1, self.share)
        return self.calibrated(self.trees.raw(features(data, starts, self.keys, self.weights)))


def _slices(texts: pa.StringArray, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, starts) of runs of texts of about so many bytes, or one longer text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, end, data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> each text's distinct words and word beginnings, hashed."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, starts in _slices(batch.column(1)):
            w = Words(data, starts)
            keys = [w.keys(), *(w.keys(n) for n in PREFIXES)]
            for k in range(b - a):
                own = np.unique(np.concatenate([x[w.first[k] : w.first[k + 1]] for x in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), toxic[a + k], np.int64))], ["gram", "toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """Fit on at most `sample` labelled rows that are not held out.

    Rows without an id or a label teach nothing. An id with several labels is toxic if one says so, one
    with several texts has the least of them; other columns are ignored. Without documents, labels or
    both kinds of them the model scores the share of toxic ones.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic"), rest.alias("part")).where("part <> 0 AND toxic IS NOT NULL").groupBy("doc_id", "part").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # known is bounded by sample
    rows = staged(rows.groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")), "labelled")

    early = rows.where("part IN (1, 2)").select("toxic", "text").dropDuplicates()  # copies are one piece of evidence
    size = early.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = size["p"] or 0, (size["n"] or 0) - (size["p"] or 0)
    entries = []
    if pos and neg:
        counted = early.mapInArrow(freeing(_grams), "gram long, toxic long").groupBy("gram").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
        weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
        counted = counted.where(F.col("p") >= max(3, pos // 70)).withColumn("w", weight).where("w >= 2")
        entries = counted.orderBy(F.desc(F.col("p") * F.col("w")), "gram").limit(lexicon).collect()
    keys = np.array([r["gram"] for r in entries], np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], np.array([r["w"] for r in entries], float)[order] if entries else np.empty(0))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in _slices(batch.column(2)):
                x = features(data, starts, model.keys, model.weights)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "part", "x"])

    got = rows.select("toxic", F.col("part").cast("long").alias("part"), "text").mapInArrow(freeing(featured), "toxic long, part long, x array<double>")
    got = got.collect()  # at most `sample` rows
    x = np.array([r["x"] for r in got]).reshape(-1, len(NAMES))
    toxic, part = np.array([r["toxic"] for r in got], float), np.array([r["part"] for r in got], np.int64)
    order = np.lexsort([part, toxic, *x.T])  # an order of their own, so that every run fits the same trees
    return model.fit(x[order], toxic[order], part[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with score, of their whole texts, and predicted (1 from 0.5 up).

    Null and empty texts get the score of a text without words. Columns named score or predicted are
    replaced, all others pass through; repeated rows each get a score.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    own = docs.select(*(F.col(f"`{c}`") for c in names))
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: lexicon and tree sizes are parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b, data, starts in _slices(pc.fill_null(batch.column(place), "")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fitted.score(data, starts))], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(own.schema.fields)).add("score", DoubleType())
    return own.mapInArrow(freeing(run), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
