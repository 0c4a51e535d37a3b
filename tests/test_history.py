"""The fold and its growth against plain Python, on random builds."""

import hashlib
import random

import pytest
from plain import plain_fold
from test_benchmarks import plain_compare
from test_engine import FEATURES, LF, LM, function

from strandline.operators import history, lineage
from strandline.operators.commits import Store
from strandline.streaming.builds import follow

FIELDS = [f.strip().split(" ")[0] for f in LF.replace("map<string,long>", "map").split(",")]


def made(seed, products=3, versions=4):
    """Random builds: functions that stay, change, vanish and come back, with random claims between them."""
    rnd = random.Random(seed)
    builds, functions, matches = {}, {}, {}
    for p in range(products):
        p = f"p{p}"
        builds[p] = [f"b{k}" for k in range(rnd.randrange(2, versions + 1))]
        kinds = [{"hash": f"h{k}", "mnemonics": {"mov": rnd.randrange(5, 30), "add": rnd.randrange(1, 9), "jmp": rnd.randrange(1, 5)}, "n": rnd.randrange(6, 40), "blocks": rnd.randrange(1, 9), "strings": rnd.sample("abcdefgh", rnd.randrange(4)), "name": rnd.choice([None, None, f"f{k}"])} for k in range(9)]
        for b in builds[p]:
            own = {}
            there = [k for k in range(9) if rnd.random() < 0.75]
            fn = lambda k, b=b: f"{b}.f{k}"
            for k in there:
                kind = kinds[k]
                changed = rnd.random() < 0.3
                calls = [fn(c) for c in there if c != k and rnd.random() < 0.2]
                own[fn(k)] = {
                    "hash": None if rnd.random() < 0.05 else f"{kind['hash']}{b if changed else ''}", "insn_count": kind["n"] + (rnd.randrange(3) if changed else 0), "mnemonics": kind["mnemonics"], "cfg_blocks": kind["blocks"], "cfg_edges": kind["blocks"] + 1,
                    "cyclomatic": 3, "cfg_hash": kind["hash"] if rnd.random() < 0.5 else None, "callees": calls, "callers": [], "callee_names": [], "imports": [], "strings": list(kind["strings"]), "constants": [], "name": kind["name"], "size": rnd.randrange(50, 150),
                }
            for f, x in own.items():
                for c in x["callees"]:
                    own[c]["callers"].append(f)
            functions.setdefault(p, {})[b] = own
        for lb, rb in zip(builds[p], builds[p][1:]):
            if rnd.random() < 0.12:
                continue  # a gap
            left, right = sorted(functions[p][lb]), sorted(functions[p][rb])
            rows, taken = [], set()
            offered = lambda names: sorted(((n, rnd.randrange(30, 100) / 100) for n in rnd.sample(names, min(3, len(names)))), key=lambda c: (-c[1], c[0]))
            for f in left:
                same = f.replace(lb, rb)
                to = same if same in right and rnd.random() < 0.7 else rnd.choice([None, None, *right])
                rows.append({"left": f, "right": to, "decision": rnd.choice(["EXACT", "STRONG", "PROBABLE", "AMBIGUOUS", "CONFLICT"]) if to else "UNRESOLVED", "diversity": rnd.randrange(4), "candidates": [] if to else offered(right)})
                taken.add(to)
            for r in rows:
                r["merge_candidate"] = r["right"] is not None and sum(x["right"] == r["right"] for x in rows) > 1
            rows += [{"left": None, "right": f, "decision": "UNRESOLVED", "diversity": 0, "merge_candidate": False, "candidates": offered(left)} for f in right if f not in taken]
            matches.setdefault(p, {})[lb, rb] = rows
    return builds, functions, matches


def frames(spark, builds, functions, matches, upto=99):
    b = [(p, x, k + 1) for p, xs in builds.items() for k, x in enumerate(xs[:upto])]
    f = [tuple({"product": p, "build": x, "fn": fn, **v}[c] for c in FIELDS) for p, xs in functions.items() for x in builds[p][:upto] for fn, v in xs[x].items()]
    m = [(p, lb, rb, r["left"], r["right"], r["decision"], r["diversity"], r["merge_candidate"], r["candidates"]) for p, xs in matches.items() for (lb, rb), rows in xs.items() if rb in builds[p][:upto] for r in rows]
    return spark.createDataFrame(b, "product string, build string, ord int"), spark.createDataFrame(f, LF), spark.createDataFrame(m, LM)


def named_lineage(product, place):
    return hashlib.sha256(f"{product}|{place[0]}|{place[1]}".encode()).hexdigest()


def plain(builds, functions, matches, upto=99, rollbacks=()):
    rows, links = [], []
    for p, xs in builds.items():
        a, b = plain_fold(xs[:upto], functions[p], matches.get(p, {}), [r for q, r in rollbacks if q == p])
        rows += [(p, x, named_lineage(p, line), f, rel, k) for x, line, f, rel, k in a]
        links += [(p, x, named_lineage(p, u), named_lineage(p, v), rel) for x, u, v, rel in b]
    return sorted(rows), sorted(links)


@pytest.mark.parametrize(("seed", "versions"), [(1, 4), (2, 3)])
def test_the_fold_is_that_of_plain_python(spark, seed, versions):
    data = made(seed, products=9, versions=versions)
    back = [("p0", "b2"), ("p3", "b1"), ("p3", "b3")]
    run = lineage.run(*frames(spark, *data), spark.createDataFrame(back, "product string, build string"))
    rows, links = plain(*data, rollbacks=back)
    assert sorted(map(tuple, run.assignments.collect())) == rows
    assert sorted(tuple(r)[:5] for r in run.links.collect()) == links
    assert {r[4] for r in rows} >= {"CONTINUATION", "MODIFIED", "UNRESOLVED", "DISAPPEARED", "MERGE_PARENT"}


def test_a_history_that_grows_is_the_one_folded_at_once(spark, tmp_path):
    builds, functions, matches = made(4, products=5, versions=4)
    store = Store(spark, f"file://{tmp_path}/s")
    for upto in (2, 4):
        b, f, m = frames(spark, builds, functions, matches, upto)
        v = history.extend(store, f"up to {upto}", b, f, m)
        assert v.number == len(store.numbers()) - 1 == history.extend(store, f"up to {upto}", b, f, m).number
        got = store.read("assignments").collect()
        rows, links = plain(builds, functions, matches, upto)
        assert sorted(tuple(r)[:6] for r in got) == rows and sorted(tuple(r)[:5] for r in store.read("links").collect()) == links
        if upto > 2:
            had = {p: min(len(x), before) for p, x in builds.items()}
            assert all((r["status"] == "CARRIED_FORWARD") == (r["step"] < had[r["product"]]) for r in got)
        before = upto
    # the second build of one product changes: it is folded anew, the others are carried forward
    p = max(builds, key=lambda x: len(builds[x]))
    for x in functions[p]["b1"].values():
        x["hash"] = "other"
    history.extend(store, "changed", *frames(spark, builds, functions, matches))
    got = store.read("assignments").collect()
    assert sorted(tuple(r)[:6] for r in got) == plain(builds, functions, matches)[0]
    assert {(r["product"] == p, r["status"]) for r in got} == {(True, "ASSIGNED"), (False, "CARRIED_FORWARD")}


def test_builds_that_come_as_a_stream_late_ones_too(spark, tmp_path):
    """Three builds, the middle one last, in two runs of the stream; then the first run's files again under another name."""
    kind = "product string, build string, at string, part string, entry long, " + FEATURES.split("entry long, ", 1)[1] + ", size long"
    rnd = random.Random(3)
    base = [function(rnd, k, 0) | {"normalized_hash": f"h{k}", "insn_count": 9 + k, "name": None, "callees": [], "callers": [], "cfg_hash": None, "mnemonics": {"mov": 3 + k, "add": 9 - k}} for k in range(6)]

    def put(run, *builds):
        for b in builds:
            rows = [{**f, "product": "p", "build": f"v{b}", "at": f"2020-0{b}", "part": "x", "entry": 100 * b + f["entry"], "size": 50, "normalized_hash": f["normalized_hash"] if (k + b) % 4 else f"changed{b}{k}"} for k, f in enumerate(base) if k != b]
            spark.createDataFrame([{k: v for k, v in r.items() if k != "component"} for r in rows], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{run}{b}")

    store = Store(spark, f"file://{tmp_path}/store")
    found = lambda: spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in/*")
    put("a", 1, 3)
    follow(found(), store, f"file://{tmp_path}/state").awaitTermination()
    assert {r["build"] for r in store.read("assignments").collect()} == {"v1", "v3"} and store.numbers() == [0]
    put("b", 2)
    put("c", 1)
    follow(found(), store, f"file://{tmp_path}/state").awaitTermination()
    assert store.numbers() == [0, 1] and store.read("functions").count() == 15
    held = {}
    for r in spark.read.schema(kind).parquet(f"file://{tmp_path}/in/a*", f"file://{tmp_path}/in/b*").collect():
        held.setdefault(r["build"], []).append(r.asDict(recursive=True) | {"hash": r["normalized_hash"]})
    named = lambda b, e: f"{b}|x|{e}"
    matches = {}
    for lb, rb in (("v1", "v2"), ("v2", "v3")):
        own = lambda r, k, b: None if r[k] is None else named(b, r[k])
        matches[lb, rb] = [{**r, "left": own(r, "left", lb), "right": own(r, "right", rb), "candidates": [(named(lb if r["left"] is None else rb, c), s) for c, s in r["candidates"]]} for r in plain_compare(held[lb], held[rb])]
    rows, _ = plain_fold(["v1", "v2", "v3"], {b: {named(b, f["entry"]): f for f in fs} for b, fs in held.items()}, matches)
    got = store.read("assignments").collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(("p", b, named_lineage("p", line), f, rel, k) for b, line, f, rel, k in rows) and {r["status"] for r in got} == {"ASSIGNED"}
