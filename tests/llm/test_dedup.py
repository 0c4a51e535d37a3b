"""Exact, line and near dedup against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from strandline.llm import components
from strandline.llm.op7_exact_dedup import exact_dedup
from strandline.llm.op8_line_dedup import dedup_lines
from strandline.llm.op10_near_dedup import near_components

SCHEMA = "doc_id long, text string, _text string, _key long, id long, v string, _norm string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", 0.5) for i, t in rows], SCHEMA)


def words(rnd, n, of=400):
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), i == min(groups[norm(t)])[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


ROWS = [(1, "a b c"), (2, "abc"), (3, " a\tb\nc "), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "é é"), (8, "éé"), (9, "A b c"), (10, "abc "), (11, "long " * 50_000), (12, "long" * 50_000), (13, "  a b c")]


def test_exact_dedup(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(frame(spark, ROWS)).collect()}
    assert got == {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(frame(spark, ROWS), hot=2).collect()}
    assert got == exact_brute(ROWS)


def test_exact_dedup_tells_texts_with_one_digest_apart(spark):
    weak = lambda norm: (F.length(norm) % 2).cast("string")
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(frame(spark, ROWS), digest=weak).collect()}
    assert got == exact_brute(ROWS)


def test_exact_dedup_of_nothing_and_of_rows_without_ids(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
    rows = exact_dedup(frame(spark, [(None, "a"), (3, "a"), (3, "a")])).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [("3", 3, 3, False), ("3", 3, 3, True), ("None", 3, 3, False)]
    rows = exact_dedup(frame(spark, [(5, "ab"), (5, "a b"), (5, "b a"), (5, " ab"), (4, "ab"), *[(None, "n n")] * 40])).collect()
    assert len(rows) == 45 and sum(r["kept"] for r in rows) == 3 and {(r["keep_id"], r["group_size"]) for r in rows} == {(5, 4), (5, 1), (None, 40)}


def lines_brute(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        own = [(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(own) - 2):
            win, here = tuple(x for _, x in own[k : k + 3]), range(own[k][0], own[k + 2][0] + 1)
            first = seen.setdefault(win, (i, here))
            if first != (i, here):  # the first occurrence stays whole, if this one overlaps it
                gone |= set(here) - (set(first[1]) if first[0] == i else set())
        out[i] = (t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines) if t is not None else 0, len(gone))
    return out


def test_line_dedup(spark):
    rnd = random.Random(3)
    some = [f"line {k}" for k in range(9)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(some) for _ in range(rnd.randrange(14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one line"), (103, "a\nb\nc\nd"), (104, "x\na\n\n b \nc\ny"), (105, "b\nc\nd"), (106, "q\n" * 3000)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(frame(spark, rows), hot=3).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_keeps_columns_and_takes_null_ids(spark):
    out = dedup_lines(frame(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc")]))
    assert out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["doc_id"] or 0, r["text"], r["v"]) for r in out.collect()) == [(0, "", "y"), (1, "a\nb\nc", "y"), (1, "a\nb\nc", "y")]
    assert dedup_lines(frame(spark, [])).collect() == []
    # of two rows without an id, or with one id and two texts, one keeps the passage
    for i in (None, 7):
        out = dedup_lines(frame(spark, [(i, "a\nb\nc\nd1"), (i, "a\nb\nc\nd2")])).collect()
        assert sorted(r["n_removed"] for r in out) == [0, 3] and sorted(len(r["text"]) for r in out) == [2, 8]
    out = dedup_lines(frame(spark, [(1, "z\nz\nz\nz\nend")])).first()
    assert out["text"] == "z\nz\nz\nend"
    named = spark.createDataFrame([("b", "a\nb\nc"), ("a", "a\nb\nc\nd"), (None, "b\nc\nd")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_lines(named).collect()} == {"a": "a\nb\nc\nd", "b": "", None: ""}


def test_line_dedup_of_long_texts_is_not_quadratic(spark):
    import time

    text = "p1\np2\np3\n" + "\n".join(f"own {k}" for k in range(40_000))
    began = time.time()
    out = dedup_lines(frame(spark, [(1, text), (2, text.replace("own", "other"))])).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 3] and time.time() - began < 30


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def test_near_dedup_finds_all_components(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        base = words(rnd, rnd.choice([4, 7, 30, 120, 300]))
        for _ in range(rnd.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = "edit" + str(rnd.random())
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "É x"), (2007, "é x")]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_components(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_dedup_of_repeated_ids_with_other_texts(spark):
    rnd = random.Random(8)
    a, b = words(rnd, 60), words(rnd, 60, 10_000)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(a)), (2, " ".join(a)), (3, " ".join(b)), (None, " ".join(b)), (None, "alone with no id"), (4, " ".join(words(rnd, 60, 10_000)))]
    first = sorted(map(str, near_components(frame(spark, rows)).collect()))
    assert first == sorted(map(str, near_components(frame(spark, rows[::-1]).repartition(3)).collect()))
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_components(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (4, 4, True)}


def test_near_dedup_of_a_hot_group_over_several_blocks(spark, monkeypatch):
    from strandline.llm import op10_near_dedup as op

    monkeypatch.setattr(op, "BLOCK", 16)
    rnd = random.Random(6)
    base, rows = words(rnd, 200, 10_000), []
    for k in range(90):
        own = list(base)
        for _ in range(rnd.randrange(1, 9)):
            own[rnd.randrange(200)] = f"e{rnd.random()}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[0][1]) for k in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_components(frame(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_dedup_of_pairs_whose_marks_agree_in_a_band_that_they_do_not_share(spark):
    rows = []
    for seed in (308, 520, 734, 1134, 1380):  # of seeds below 1,500, those with such a band before the first shared one
        rnd = random.Random(seed)
        base = [f"w{rnd.randrange(10**6)}" for _ in range(130)]
        own = list(base)
        own[40], own[90] = "x", "y"
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(own))]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_components(frame(spark, rows)).collect()}
    assert got == near_brute(rows) and sum(kept for _, _, kept in got.values()) == 5


def test_near_dedup_of_nothing_and_of_repeated_and_missing_ids(spark):
    assert near_components(frame(spark, [])).collect() == []
    rows = near_components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone"), (None, None)])).collect()
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert got == [(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (None, None, True)]


def test_components_by_stars_and_in_one_task(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 540)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r["v"]: r["label"] for r in components.components(df).collect()}
    stars = {r["v"]: r["label"] for r in components.components(df, one_task=0).collect()}
    assert one == stars
    assert all(one[k] == 500 for k in range(500, 541))
    assert components.components(df.limit(0)).collect() == []


def test_frequent_keys_meet_their_groups_as_others_do(spark):
    from strandline.llm.common import meeting

    rnd = random.Random(7)
    rows = [(k, rnd.choice("aaaabbcdefg"), rnd.randrange(2)) for k in range(200)] + [(300, "alone", 0), (301, None, 1)]
    df = spark.createDataFrame(rows, "i long, k string, j int")
    counts = {}
    for _, k, j in rows[:200]:
        counts[k, j] = counts.get((k, j), 0) + 1
    groups = spark.createDataFrame([(k, j, n, f"{k}{j}") for (k, j), n in counts.items()], "k string, j int, _n long, g string")
    want = sorted((i, k, j, counts.get((k, j)), f"{k}{j}" if (k, j) in counts else None) for i, k, j in rows)
    for hot, most in ((5, 100), (1, 100), (10**6, 100), (1, 2)):
        got = meeting(df, groups, ["k", "j"], ["i"], hot=hot, most=most).select("i", "k", "j", "_n", "g").collect()
        assert sorted(map(tuple, got)) == want
