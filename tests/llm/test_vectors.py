"""The vector searches against comparisons of every pair."""

import math

import numpy as np
import pytest

from strandline.llm import op11_hard_negatives as op11
from strandline.llm import op13_vector_search as op13
from strandline.llm.op11_hard_negatives import hard_negatives
from strandline.llm.op13_vector_search import nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dim))
    out[: n // 2] += 2 * rng.normal(size=(5, dim))[rng.integers(0, 5, n // 2)]  # half of them in clusters
    out[n - copies :] = out[0]
    return (out / np.linalg.norm(out, axis=1)[:, None]).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 0.5, "r") for i, v, label in rows], SCHEMA)


def odd_rows(dim):
    v = [0.1] * dim
    return [
        (None, v, 1), (10_000, None, 1), (10_050, [0.0] * dim, 2), (10_100, v[:-1] + [None], 3), (10_150, v[:-1] + [math.nan], 3), (10_200, v[:-1] + [math.inf], 3),
        (10_250, v[:-1], 4), (10_300, [], 4), (10_350, v, None), (10_400, v, 1), (10_400, v, 1), (10_400, [0.2] * dim, 0),
    ]


def one_each(rows, dim, labelled):
    good = {}
    for i, v, label in rows:
        if i is None or v is None or len(v) != dim or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if labelled:
            v = [math.floor(256 * x) for x in v]
        elif not any(v):
            continue
        key = (label, v) if labelled else (v,)
        good[i] = min(good.get(i, key), key)
    return good


def nearest_brute(rows, dim, k=5):
    good = {i: np.array(v[0]) for i, v in one_each(rows, dim, False).items()}
    out = {}
    for q in good:
        if q % 50 == 0:
            scored = sorted((-float((v * good[q]).sum()) / math.sqrt((v * v).sum()) / math.sqrt((good[q] ** 2).sum()), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"probes": 1, "lists": 7, "block": 8}, {"lists": 1, "sample": 40}])
def test_nearest_vectors_are_those_of_all_pairs(spark, options):
    rows = [(i, v, 0) for i, v in enumerate(vectors(700, 9, 3, copies=60))] + odd_rows(9)
    got = {}
    for r in nearest_vectors(frame(spark, rows).repartition(3), **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest_brute(rows, 9)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert np.allclose([s for _, _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)
        assert [i for _, i, _ in found] == [i for i, _ in want[q]], q


def test_few_and_no_vectors(spark):
    assert nearest_vectors(frame(spark, [])).collect() == []
    assert nearest_vectors(frame(spark, [(50, [0.0, 0.0], 1), (100, None, 1)])).collect() == []
    tiny = [(0, [1e-30, 0.0], 1), (50, [1e30, 1e30], 1), (3, [0.0, -1.0], 1)]
    got = [tuple(r) for r in nearest_vectors(frame(spark, tiny)).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert np.allclose([r[3] for r in got], [0.5**0.5, 0, 0.5**0.5, -(0.5**0.5)])
    assert nearest_vectors(frame(spark, [(7, [1.0], 1)])).collect() == []
    asked = spark.createDataFrame([(3,), (3,), (99,)], "vec_id long")
    assert [tuple(r)[:3] for r in nearest_vectors(frame(spark, tiny), asked, k=1).collect()] == [(3, 1, 0)]


def test_the_cone_and_the_codes_discard_most_pairs():
    own = vectors(4000, 16, 5).astype(np.float64)
    index = op13.fitted(own, 30)
    of, codes, left = op13.encoded(own, index)
    said = index.centroids[of].copy()
    for m, p in enumerate(index.parts):
        said[:, p] += index.books[m][codes[:, m]]
    assert np.allclose(np.sqrt(((own - said) ** 2).sum(1)), left) and left.mean() < 0.2
    assert (np.abs(own[:50] @ own.T - own[:50] @ said.T) <= left + 1e-12).all()


def mined_brute(rows, dim):
    good = one_each(rows, dim, True)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in good.items():
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in good.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(i, -t) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(a, p, k, i, -s, t) for k, (i, t) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"block": 2, "sample": 30}])
def test_mined_negatives_are_those_of_all_pairs(spark, options, monkeypatch):
    monkeypatch.setattr(op11, "PAIRS", 100)
    rows = [(i, v, i * 7 % 4) for i, v in enumerate(vectors(900, 9, 4, copies=80))] + odd_rows(9) + [(20_000, [2.0**40] * 9, 1), (5, [9.0] * 9, 3), (300, [-1000.0] * 9, 1)]
    got = [tuple(r) for r in hard_negatives(frame(spark, rows).repartition(3), **options).collect()]
    rows = [r for r in rows if r[0] != 20_000]  # its products have more than 64 bits
    assert len(got) == len(set(got)) and set(got) == mined_brute(rows, 9)


def test_no_anchors_no_positives(spark):
    assert hard_negatives(frame(spark, [])).collect() == []
    assert hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])).collect() == []
    assert hard_negatives(frame(spark, [(0, [1.0], 1), (2, [1.0], 2)])).collect() == []
    small = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [0.0, 0.0], 1)]
    assert [tuple(r) for r in hard_negatives(frame(spark, small)).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_pairs_out_of_reach_are_discarded_early():
    rng = np.random.default_rng(1)
    own = np.floor(256 * vectors(500, 32, 6).astype(np.float64))
    axes = op11.rotation(own)
    rows = op11.Rotated(own, axes)
    best = rng.integers(0, 500, 20)
    least = np.sort(own[best] @ own.T, axis=1)[:, -5]
    got = [(i, j, s) for i, j, s in op11.survivors(rows, rows.take(best), least, None, None, op11._slack(axes))]
    i, j, s = (np.concatenate(x) for x in zip(*got))
    assert (s == (own[i] * own[best[j]]).sum(1)).all() and len(i) < 2500
    found = set(zip(i.tolist(), j.tolist()))
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(own @ own[best].T >= least))} <= found
