"""The whole comparison of the registered queries, on their own tables, against plain Python."""

import re
from collections import Counter

import test_engine
from oracle import SF
from plain import families, plain_fold, weighted
from test_engine import plain_match

from strandline.operators import features
from strandline.operators.graph import _kept
from strandline.plans import analytics, benchmarks
from strandline.session import table


def plain_compare(left, right):
    """Consensus rows of one part, with candidates, and the score that the change report makes of them."""
    L, R = {f["entry"]: f for f in left}, {f["entry"]: f for f in right}
    found = plain_match(left, right)
    matched = {a: b for a, (b, _, _) in found.items()}
    ends = set(matched.values())
    linked = lambda a, b: ({matched[c] for c in L[a]["callees"] if c in matched}, {c for c in R[b]["callees"] if c in ends})
    fits = lambda a, b: min(a, b) * 3 >= max(a, b) or abs(a - b) <= 4
    score = lambda a, b: weighted(families(L[a], R[b], linked(a, b)))
    best = lambda pairs: sorted(((x, s) for x, s in pairs), key=lambda c: (-c[1], c[0]))[:3]
    rows, taken = [], set()
    for a in L:
        row = {"left": a, "right": None, "decision": "UNRESOLVED", "diversity": 0, "merge_candidate": False, "candidates": []}
        if a not in found:
            row["candidates"] = best((b, score(a, b)) for b in R if fits(L[a]["insn_count"], R[b]["insn_count"]))
        elif found[a][1] != "UNRESOLVED":
            b, decision, _ = found[a]
            n = sum(v >= 0.5 for v in families(L[a], R[b], linked(a, b)).values())
            if decision not in ("EXACT", "AMBIGUOUS"):
                decision = "STRONG" if n >= 3 else "PROBABLE" if n >= 2 or decision == "STRONG" else "UNRESOLVED"
            row |= {"right": b, "decision": decision, "diversity": n}
            taken.add(b)
        rows.append(row)
    for b in R:
        if b not in taken:
            offers = best((a, score(a, b)) for a in L if fits(L[a]["insn_count"], R[b]["insn_count"])) if b not in ends else []
            rows.append({"left": None, "right": b, "decision": "UNRESOLVED", "diversity": 0, "merge_candidate": False, "candidates": offers})
    return rows


def test_the_chain_over_documents_is_that_of_plain_python(spark):
    docs = table(spark, SF, "documents")
    builds, functions = benchmarks.functions_of(docs)
    order, held = {}, {}
    for r in builds.orderBy("product", "ord").collect():
        order.setdefault(r["product"], []).append(r["build"])
    for r in _kept(functions).collect():
        f = r.asDict(recursive=True) | {"hash": r["normalized_hash"]}
        held.setdefault((r["product"], r["part"], r["build"]), []).append(f)
    rows, changed = [], {}
    for p, bs in order.items():
        named = lambda b, part, e: f"{b}|{part}|{e}"
        fns, matches = {b: {} for b in bs}, {}
        for (q, part, b), own in held.items():
            if q == p:
                for f in own:
                    fns[b][named(b, part, f["entry"])] = f | {"callees": [named(b, part, e) for e in f["callees"]], "callers": [named(b, part, e) for e in f["callers"]]}
        for lb, rb in zip(bs, bs[1:]):
            for part in sorted({k[1] for k in held if k[0] == p}):
                left, right = held.get((p, part, lb)), held.get((p, part, rb))
                if not left or not right:
                    continue
                compared = plain_compare(left, right)
                matches.setdefault((lb, rb), []).extend(
                    {**r, "left": r["left"] is not None and named(lb, part, r["left"]) or None, "right": r["right"] is not None and named(rb, part, r["right"]) or None, "candidates": [(named(rb if r["left"] is not None else lb, part, c), s) for c, s in r["candidates"]]}
                    for r in compared
                )
                hl, hr = ({f["entry"]: f for f in x} for x in (left, right))
                pairs = [(r["left"], r["right"]) for r in compared if r["decision"] in ("STRONG", "PROBABLE") and hl[r["left"]]["hash"] != hr[r["right"]]["hash"]]
                changed[p, part, lb] = (len(left), len(right), sum(r["left"] is not None and r["decision"] == "UNRESOLVED" for r in compared), sum(r["left"] is None for r in compared), len({b for _, b in pairs}), sum(hr[b]["cyclomatic"] - hl[a]["cyclomatic"] for a, b in pairs))
        got, _ = plain_fold(bs, fns, matches)
        rows += [(p, b, f, rel, k) for b, _, f, rel, k in got]
    out = benchmarks.QUERIES["compared_lineages"](spark, SF).collect()
    assert sorted((r["product"], r["build"], r["fn"], r["relation"], r["step"]) for r in out) == sorted(rows)
    assert {(r["product"], r["part"], r["left_build"]): (r["functions_left"], r["functions_right"], r["unresolved_left"], r["unresolved_right"], r["modified_functions"], r["cyclomatic_delta_sum"]) for r in benchmarks.QUERIES["compared_changes"](spark, SF).collect()} == changed


def plain_functions(docs):
    """component -> the functions of its two sides, from the texts alone."""
    out, names = {}, {}
    for d in docs:
        words = re.findall("[a-z]+", d["text"].lower())
        lines, kinds, e = d["text"].split("\n"), set(words), d["doc_id"]
        component = f"{d['lang']}:{d['source']}"
        name = words[0] if words and len(words[0]) >= 4 else None
        f = {
            "entry": e, "insn_count": len(words), "mnemonics": dict(Counter(words)), "hash": "".join(words) or None, "cfg_hash": None, "cfg_blocks": len(lines), "cfg_edges": len(kinds), "cyclomatic": max(1, len(kinds) - len(lines) + 2),
            "callees": [e + 40, e + 80], "callers": [e - 40, e - 80], "imports": {w for w in kinds if len(w) >= 12}, "strings": set(lines), "constants": set(re.findall("[0-9]+", d["text"])), "name": name,
        }
        names[component, e] = name
        out.setdefault(component, ([], []))[e // 20 % 2].append(f | {"normalized_hash": f["hash"]})
    for component, sides in out.items():
        for f in (*sides[0], *sides[1]):
            f["callee_names"] = {names.get((component, c)) for c in f["callees"]} - {None}
    return out


def test_documents_have_their_digit_runs_and_the_names_of_what_they_call(spark):
    docs = table(spark, SF, "documents")
    want = {f["entry"]: (f["constants"], f["callee_names"]) for sides in plain_functions(docs.collect()).values() for side in sides for f in side}
    got = [r for side in features.documents_as_functions(docs) for r in features.with_callee_names(side).select("entry", "constants", "callee_names").collect()]
    assert {r["entry"]: (set(r["constants"]), set(r["callee_names"])) for r in got} == want and len(got) == len(want)
    assert any(c for c, _ in want.values()) and any(n for _, n in want.values())


def test_documents_are_matched_by_all_that_they_hold(spark, monkeypatch):
    def score(l, r, matched):  # noqa: E741
        ends = set(matched.values())
        return weighted(families(l, r, ({matched[c] for c in l["callees"] if c in matched}, {c for c in r["callees"] if c in ends})))

    monkeypatch.setattr(test_engine, "plain_score", score)
    plain = plain_functions(table(spark, SF, "documents").collect())
    want = {(c, a): m for c, sides in plain.items() for a, m in plain_match(*sides).items()}
    got = {(r["component"], r["left"]): (r["right"], r["decision"], round(r["score"], 3)) for r in analytics.feature_match(spark, SF).collect()}
    assert got == want and got


def test_constants_and_names_of_calls_weigh_in_a_match(spark, tmp_path):
    rows = [(0, "alpha one two three 11 12"), (20, "alpha one two four 11 12"), (40, "called one"), (60, "called two"), (80, "zz"), (100, "zz")]
    docs = spark.createDataFrame([(k, t, "en", "s0", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["left"]: r["score"] for r in analytics.feature_match(spark, str(tmp_path)).collect()}
    left, right = plain_functions(docs.collect())["en:s0"]
    assert found[0] == weighted(families(left[0], right[0], ({60, 100}, {60, 100})))
    assert families(left[0], right[0])["data-reference"] == 0.5
