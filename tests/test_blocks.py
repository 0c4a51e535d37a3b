"""Scores of blocks of functions against the column expressions, pair by pair."""

import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_engine import FEATURES, function

from strandline.functions import scalar, stats
from strandline.operators import blocks, comparison, features, lineage, match
from strandline.operators.graph import _kept
from strandline.plans import analytics, benchmarks
from strandline.session import table

CALLS = "component string, left long, right long"


def both_ways(spark, left, right, block, matched=None):
    a, b = match.with_matched_callees(left, right, spark.createDataFrame([], CALLS) if matched is None else matched)
    want = {(r["component"], r["left"], r["right"]): r["score"] for r in match.scored(match.candidates(a, b)).collect()}
    got = [(r["component"], r["left"], r["right"], r["score"]) for r in match.best_pairs(a, b, 0.0, block=block).collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    return a, b, want


@pytest.mark.parametrize("block", [5, 2048])
def test_scores_of_blocks_are_those_of_the_columns(spark, block):
    rnd = random.Random(7)
    left, right = [function(rnd, k, 0) for k in range(30)], [function(rnd, 100 + k, 100) for k in range(30)]
    left[3] |= {"insn_count": None, "mnemonics": None}
    left[4] |= {"mnemonics": {}, "imports": [], "strings": [], "callees": [], "callers": []}
    right[4] |= {"insn_count": 0, "mnemonics": {}, "cfg_blocks": None}
    right[5] |= {"imports": None, "strings": None, "callees": [100, 101]}
    matched = spark.createDataFrame([("c", k, 100 + k) for k in range(0, 30, 2)], CALLS)
    a, b, want = both_ways(spark, spark.createDataFrame(left, FEATURES), spark.createDataFrame(right, FEATURES), block, matched)
    best = {(x, y) for x in {k[1] for k in want} for _, y in sorted((-s, k[2]) for k, s in want.items() if k[1] == x)[:3]}
    some = {(r["left"], r["right"]): r["score"] for r in match.best_pairs(a, b, 0.6, 3, block).collect()}
    assert best | {k[1:] for k, s in want.items() if s >= 0.6} <= set(some) and all(want["c", *k] == s for k, s in some.items())
    assert len({(r["left"], r["right"]) for r in match.top_candidates(match.best_pairs(a, b, n=3, block=block), "left").collect()} ^ best) == 0


def test_scores_of_documents_are_those_of_the_columns(spark, monkeypatch):
    monkeypatch.setattr(blocks, "STRIP", 100)
    left, right = features.documents_as_functions(table(spark, SF, "documents"))
    both_ways(spark, left.localCheckpoint(), right.localCheckpoint(), 2048)


@pytest.mark.parametrize("share, entries", [(10**9, 1 << 22), (0, 1 << 22), (3, 7)])
def test_shared_values_are_counted_however_frequent(monkeypatch, share, entries):
    monkeypatch.setattr(blocks, "SHARE", share)
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    rnd = random.Random(5)
    sides = []
    for n in (9, 7):
        sets = [rnd.sample(range(12), rnd.randrange(9)) for _ in range(n)]
        own = blocks.Side.__new__(blocks.Side)
        own.n, own.length, own.values = n, {"x": np.array([float(len(s)) for s in sets])}, {"x": np.array([v for s in sets for v in s])}
        own.counts = np.array([float(rnd.randrange(1, 9)) for _ in own.values["x"]])
        weights = iter(own.counts)
        sides.append((own, [{v: next(weights) for v in s} for s in sets]))
    (l, a), (r, b) = sides  # noqa: E741
    shared = blocks.Shared(l, r, "x", True)
    got = np.concatenate([shared.strip(0, 4), shared.strip(4, 9)])
    assert got.tolist() == [[sum(v * y[k] for k, v in x.items() if k in y) for y in b] for x in a]


def test_rounding_is_by_decimal_digits():
    x = [0.12345, 0.00005, 1 / 32, 3 / 32, 0.99995, 1.0, 0.0, 0.1 + 0.2, 0.28125, 0.02675, *(k / 20000 for k in range(400))]
    assert blocks.rounded(np.array(x)).tolist() == [float(Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in x]


def test_greedy_rounds_and_the_sequential_end_agree(spark):
    rnd = random.Random(4)
    pairs = spark.createDataFrame([(c, a, b, rnd.randrange(6) / 10) for c in "xy" for a in range(20) for b in range(20)], match.PAIRS)
    whole, ended = (sorted(map(tuple, match.greedy(pairs, few).collect())) for few in (0, 30))
    assert whole == ended == sorted(map(tuple, match.greedy(pairs).collect())) and len(whole) == 40


def test_structural_changes_need_no_offers(spark):
    builds, functions = benchmarks.functions_of(table(spark, SF, "documents"))
    functions, steps = functions.localCheckpoint(), comparison.transitions(builds).localCheckpoint()
    with_offers, without = (comparison.compare(functions, steps, offers=x) for x in (True, False))
    own = lambda c: sorted(map(tuple, c.matches.select("component", "left", "right", "decision", "side").fillna(-1).collect()))
    assert own(with_offers) == own(without) and without.matches.where("size(candidates) > 0").isEmpty() and not with_offers.matches.where("size(candidates) > 0").isEmpty()


@pytest.mark.parametrize("block", [7, 1024])
def test_grades_of_blocks_are_those_of_the_columns(spark, block):
    rnd = random.Random(11)
    rows = [function(rnd, k, 0) | {"normalized_hash": rnd.choice([None, "h1", "h2", "h3"]), "strings": rnd.sample(["s1", "s2", "s3", "s4"], rnd.randrange(5))} for k in range(60)]
    rows[3] |= {"insn_count": None, "mnemonics": None, "strings": None, "imports": None}
    rows[40] |= {"insn_count": 0, "mnemonics": {}, "name": None}
    fns = spark.createDataFrame(rows, FEATURES).withColumnsRenamed({"component": "product", "normalized_hash": "hash"}).withColumn("fn", F.col("entry").cast("string")).drop("entry")
    old = lineage._structs(fns.where("fn < 30"), "old").withColumnRenamed("old_fn", "lineage")
    new = lineage._structs(fns.where("fn >= 30"), "new").withColumnRenamed("new_fn", "fn")
    none = F.array().cast("array<string>")
    want = lineage.assess(lineage.paired(old, new).withColumns({"old_callers": none, "new_callers": none, "rollback": F.lit(False)})).select("product", "lineage", "fn", "status", "contradicted").collect()
    assert {r["status"] for r in want} == {"CANDIDATE", "REJECTED"}
    assert sorted(map(tuple, lineage.graded_pairs(old, new, block=block).collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, lineage.graded_pairs(old, new, False, block=block).collect())) == sorted(tuple(r) for r in want if r["status"] != "REJECTED")


def test_claimable_pairs_of_equal_sizes_need_like_instructions(spark):
    one = function(random.Random(1), 1, 0) | {"component": "p", "insn_count": 20, "normalized_hash": None, "strings": ["s1"], "imports": [], "cfg_hash": None, "name": None}
    rows = [one | {"entry": 1, "mnemonics": {"a": 20}}, one | {"entry": 2, "mnemonics": {"b": 20}, "strings": ["s2"]}, one | {"entry": 3, "mnemonics": {"a": 19, "b": 1}, "strings": ["s2"]}]
    fns = spark.createDataFrame(rows, FEATURES).withColumnsRenamed({"component": "product", "normalized_hash": "hash"}).withColumn("fn", F.col("entry").cast("string")).drop("entry")
    none = F.array().cast("array<string>")
    old = lineage._structs(fns.where("fn = '1'"), "old").withColumnRenamed("old_fn", "lineage").withColumn("old_callers", none)
    new = lineage._structs(fns.where("fn <> '1'"), "new").withColumnRenamed("new_fn", "fn").withColumn("new_callers", none)
    assert [r["fn"] for r in lineage.claimable(old, new).collect()] == ["3"]


def test_prepared_functions_have_the_numbers_and_scores_of_whole_ones(spark):
    left, right = features.documents_as_functions(table(spark, SF, "documents"))
    matched = _kept(left.select("component", F.col("entry").alias("left")).join(right.select("component", F.col("entry").alias("right")), "component").where("right = left + 20"))
    for f, g in zip(match.with_matched_callees(left, right, matched), match.with_matched_callees(blocks.prepared(left), blocks.prepared(right), matched)):
        sets = lambda r: [tuple(sorted(v)) if k in ("called", "items") and v is not None else v for k, v in r.asDict().items()]
        assert sorted(map(sets, blocks.numbers(f, "entry").collect()), key=str) == sorted(map(sets, blocks.numbers(g, "entry").collect()), key=str)
    plain, hashed = (sorted(map(tuple, match.match(*sides).select("component", "left", "right", "decision", "score", *match.WEIGHTS).collect()), key=str) for sides in ((left, right), (blocks.prepared(left), blocks.prepared(right))))
    assert plain == hashed and plain


def test_only_functions_near_a_match_are_looked_for_where_lineages_ask(spark):
    f = lambda rows: spark.createDataFrame(rows, "component string, entry long, callees array<bigint>, callers array<bigint>")
    left = f([("c", 1, [2], [9]), ("c", 2, [], [1]), ("c", 3, [1], []), ("c", 4, [], [9]), ("c", 5, [6], [7]), ("d", 2, [], [1])])
    right = f([("c", 11, [12], []), ("c", 12, [], [11]), ("c", 13, [11], []), ("d", 12, [], [11])])
    near = match.near_matches(left, right, spark.createDataFrame([("c", 1, 11)], "component string, left long, right long"))
    assert sorted((r["component"], r["side"], r["entry"]) for r in near.collect()) == [("c", "left", 1), ("c", "left", 2), ("c", "left", 3), ("c", "left", 4), ("c", "right", 12)]


@pytest.mark.parametrize("block", [5, 1024])
def test_item_scores_of_blocks_are_those_of_the_columns(spark, block):
    left, right = (side.localCheckpoint() for side in features.documents_as_functions(table(spark, SF, "documents")))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    parts = lambda c: F.floor(c * 10000 + 0.000001).cast("long")
    pairs = match.candidates(left, right)
    want = pairs.select("component", l["entry"], r["entry"], parts(stats.jaccard_of_sets(l["strings"], r["strings"])), parts(scalar.size_ratio(l["insn_count"], r["insn_count"]))).collect()
    got = match.item_scores(left, right, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 100


def test_family_scores_pair_documents_of_every_size_with_those_of_none(spark, tmp_path):
    texts = [None, "", "7 7", "one", "one\none\ntwo", "a b c d e f g h\none", None, " ".join("word" * 40), "x\n" * 30, "one\ntwo"]
    rows = [(k, texts[k * 7 // 20 % 10 if k % 3 else k % 10], "en", "s1") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = analytics.family_scores(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({analytics.SQL['family_scores']})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and any(None in r for r in want)


def test_family_scores_deal_the_pairs_of_a_component_to_blocks(spark):
    plan = analytics.family_scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "FlatMapCoGroupsInArrow" in plan
