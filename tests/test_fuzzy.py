"""Digests of bytes, their distance, and the banded join against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import fuzzy


def plain(data):
    if data is None or len(data) < 3:
        return None
    counts = [0] * 128
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[(5 * a + 37 * b + 101 * c) % 128] += 1
    edges = [sorted(counts)[k] for k in (31, 63, 95)]
    return [sum(n > e for e in edges) for n in counts]


def test_near_bytes_have_near_digests_and_no_pair_is_lost(spark):
    rnd = random.Random(1)
    datas = [None, b"", b"ab", b"abc", bytes(300)]
    for _ in range(12):
        base = bytearray(rnd.randrange(256) for _ in range(rnd.choice([400, 4000, 20_000])))
        datas.append(bytes(base))
        for edits in (0, 1, 1, 2, 5, 40):
            own = bytearray(base)
            for _ in range(edits):
                own[rnd.randrange(len(own))] = rnd.randrange(256)
            datas.append(bytes(own))
    df = spark.createDataFrame(list(enumerate(datas)), "id int, content binary").select("id", fuzzy.digest("content").alias("digest")).cache()
    codes = {k: plain(d) for k, d in enumerate(datas)}
    known = {k: c for k, c in codes.items() if c is not None}
    head = {k: min(j for j in known if known[j] == c) for k, c in known.items()}
    apart = lambda a, b: int(np.abs(np.array(known[a]) - known[b]).sum())
    both = df.select(F.col("id").alias("a"), F.col("digest").alias("x")).crossJoin(df.select(F.col("id").alias("b"), F.col("digest").alias("y"))).select("a", "b", fuzzy.distance(F.col("x"), F.col("y")).alias("d"))
    assert all(r["d"] == (apart(r["a"], r["b"]) if r["a"] in known and r["b"] in known else None) for r in both.collect())
    for most in (11, 3):
        pairs, classes = fuzzy.near(df, "id", most)
        heads = sorted(set(head.values()))
        want = sorted((a, b, apart(a, b)) for a in heads for b in heads if a < b and apart(a, b) <= most)
        assert sorted(map(tuple, pairs.collect())) == want and {r["key"]: r["head"] for r in classes.collect()} == head
    assert len(want) and max(apart(5 + 7 * k, 5 + 7 * k + 2) for k in range(12)) < min(apart(5, 5 + 7 * k) for k in range(1, 12))


def test_a_part_that_all_have_in_common_pairs_few(spark):
    """Digests that agree in one word of two and are apart in all else meet in no key."""
    rnd = np.random.default_rng(5)
    words = rnd.integers(-(2**63), 2**63 - 1, (600, 6))
    words[:, 2] = 5
    df = spark.createDataFrame([(k, list(map(int, w))) for k, w in enumerate(words)], "id int, digest array<bigint>")
    keys = df.select("id", F.explode(fuzzy.near_keys("digest")).alias("value"))
    assert keys.count() == 600 * 40
    met = keys.groupBy("value").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert met < 600 and fuzzy.near(df, "id")[0].count() == 0
