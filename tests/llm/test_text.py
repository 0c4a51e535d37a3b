"""Decontamination, toxicity, URLs and HTML against brute force and small cases."""

import hashlib
import random
import re

import numpy as np

from strandline.llm import op9_toxicity as toxic
from strandline.llm.op1_decontamination import decontaminate
from strandline.llm.op4_url_filter import RULES, filter_urls
from strandline.llm.op6_html_text import extract, extract_pages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits_brute(docs, items):
    wins = {}
    for i, t in items:
        ws = words(t)
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1) if n else ():
            wins.setdefault(tuple(ws[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        ws, hit, own = words(t), set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                got = wins.get(tuple(ws[k : k + n]))
                if got:
                    own |= got
                    hit |= set(range(k, k + n))
        out[d] = (len(ws), len(hit), sorted(own))
    return out


def check_hits(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _text string, _key int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _ws string")
    got = decontaminate(d, b).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == hits_brute(docs, items)
    for r in got:
        assert sum(s["e"] - s["s"] for s in r["spans"]) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"])
        assert all(a["e"] < b["s"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_every_shared_window_is_found(spark):
    rnd = random.Random(1)
    some = [f"w{k}" for k in range(30)] + ["É", "é", "Word9", "ß"]
    text = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    items = [(k, text(rnd.choice([10, 11, 12, 25, 40]))) for k in range(25)] + [(99, None), (98, "..."), (97, "w1 " * 30)]
    docs = []
    for k in range(40):
        own = text(rnd.randrange(60))
        if k % 2:
            ws = words(items[k % 25][1])
            a = rnd.randrange(len(ws) - 9)
            own += " | " + "-".join(ws[a : a + rnd.choice([9, 10, 14])]).upper() + " , " + text(12)
        docs.append((k, own))
    docs += [(100, None), (101, ""), (102, "w1, " * 3000), (103, items[3][1] + " " + items[3][1]), (104, items[3][1])]
    check_hits(spark, docs, items)


def test_short_items_are_whole_windows(spark):
    items = [(1, "one"), (2, "two words"), (3, "a b c d e f"), (4, "q r s t u v w"), (5, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"), (6, "one")]
    docs = [(1, "say one and two words"), (2, "two, words"), (3, "x a b c d e f g"), (4, "q r s t u v"), (5, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10"), (6, "k2 k3 k4 k5 k6 k7 k8 k9 k10"), (7, "nothing")]
    check_hits(spark, docs, items)


def test_nothing_to_find_and_nothing_to_search(spark):
    check_hits(spark, [(1, "a b"), (2, None)], [])
    check_hits(spark, [], [(1, "a b c")])


URLS = [
    "http://Example.ORG/es/1", "https://a.example.org/en/157", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1?q#f", "http://x.com/de/", "http://x.com", "http://org", "http://org/", "http://x.net/a",
    None, "", "no scheme/path", "://org/", "http://x.com?/fr/", "http://x.com#/fr/", "ftp://user@EXAMPLE.org:80/es/", "http://com/fr/" + "x" * 5000, "http://.org/es/", "http://example.org/en/1",
]


def url_brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else None
    host, path = "", ""
    if rest is not None:
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls(spark, monkeypatch):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(3, URLS[3], "x", "y")], "page_id long, url string, host string, rule string")
    want = sorted((k, *url_brute(u)) for k, u in [*enumerate(URLS), (3, URLS[3])])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, filter_urls(df, RULES).collect()), key=key) == sorted(want, key=key)
    from strandline.llm import op4_url_filter as op

    monkeypatch.setattr(op, "MOST_RULES", 2)  # several passes
    assert sorted(map(tuple, filter_urls(df, RULES).collect()), key=key) == sorted(want, key=key)
    assert filter_urls(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in filter_urls(df, [], default="block").collect()} == {"block"}


def test_urls_against_many_rules_of_one_folder():
    import time

    from strandline.llm.op4_url_filter import Trie

    rules = [("block" if k % 2 else "allow", "h.org", f"/a/{k}") for k in range(100_000)] + [("allow", "h.org", "/a/77777"), ("block", "org", "/")]
    trie = Trie(rules)
    began = time.time()
    for _ in range(1000):
        assert trie.find("h.org", "/a/77777x") == ("block", "h.org/a/77777") and trie.find("x.org", "/") == ("block", "org/") and trie.find("h.com", "/a/1") is None
    assert time.time() - began < 1


def test_html_cases():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One  <b>two</b>&nbsp;three<br>four<p>Five<ul><li>x<li>y</ul><div class="share">Share</div><form><p>Mail</p></form><!-- <p>no</p> --><table><tr><td>c1<td>c2</table>
    <blockquote>q</blockquote><section class="comments"><article><p>Reader says</p></article></section></article><aside><p>side</p></aside><footer>&copy;</footer></body></html>"""
    assert extract(page, set()).split("\n\n") == ["Head & more", "One two three four", "Five", "x", "y", "c1", "c2", "q"]
    assert extract("", set()) == "" and extract("plain &lt;text&gt;", set()) == "plain <text>"
    assert extract("<div>a</div><p>b<script>c", set()) == "a\n\nb"
    assert extract("<p>a<div>b</p>c", set()).split("\n\n") == ["a", "b", "c"]
    assert extract("<div>" * 5000 + "deep", set()) == "deep"
    assert extract('<main><p class="a>b">x</main>y', set()) == "x"


def test_html_names_do_not_cut_an_article():
    page = """<article><h1>T</h1><div class="related-work"><p>kept prose</p></div><p class="notice">kept too</p><section id="search"><p>on search</p></section><ul class="menu"><li>soup</ul>
    <div class="ad">Buy</div><p class="ad">a word on ads</p><div id="comments"><p>reader</p></div></article><div class="related">out</div>"""
    assert extract(page, set()).split("\n\n") == ["T", "kept prose", "kept too", "on search", "soup", "a word on ads"]


def test_html_of_crafted_pages_takes_linear_time():
    import time

    for page in ("<div>" * 20_000 + "</x>" * 20_000 + "end", "<b>" * 20_000 + "<p>" * 20_000 + "end", "<ul>" + "<li><b>" * 20_000 + "</i>" * 20_000 + "end"):
        began = time.time()
        assert extract(page, set()).endswith("end") and time.time() - began < 5


def test_html_against_counts(spark):
    """Pages of random pieces, of which those on enough pages of a host or section must go, and only those."""
    rnd = random.Random(9)
    pieces = [(f"piece {k}", rnd.choice([0.02, 0.1, 0.4, 0.45, 0.55, 0.6, 0.9])) for k in range(40)]
    pages = []
    for k in range(300):
        host, section = rnd.choice(["a.org", "a.org", "b.org"]), rnd.choice(["x", "y", "z"])
        own = [t for t, share in pieces if rnd.random() < share] + [f"own {k}"]
        rnd.shuffle(own)
        pages.append((k, host, section, own))
    want = {}
    for k, host, section, own in pages:
        near = [p for p in pages if p[1:3] == (host, section)]
        far = [p for p in pages if p[1] == host]
        on = lambda group, t: sum(t in p[3] for p in group)
        gone = {t for t in own if any(on(g, t) >= max(5, min(len(g) / 2, 70)) for g in (near, far))}
        want[k] = "\n\n".join(t for t in own if t not in gone)
    rows = [(k, f"http://{h}/{s}/{k}", "<body>" + "".join(f"<div><span>{t}</span></div>" for t in own) + "</body>") for k, h, s, own in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_pages(df, many=70).collect()} == want


def test_html_templates_go_and_articles_stay(spark):
    box = "<div class=x><p>Subscribe to our daily letter</p></div>"
    rows = [(k, f"http://h.com/{k}", f"<body>{box}<div><p>Body number {k}</p></div></body>") for k in range(8)]
    rows += [(100 + k, f"http://i.com/{k}", "<body><article><p>The same article</p></article></body>") for k in range(9)]
    rows += [(200, "http://j.com/1", f"<body>{box}</body>"), (201, None, None), (202, "http://h.com/9", ""), (200, "http://j.com/1", f"<body>{box}</body>")]
    df = spark.createDataFrame([(*r, 5, "t") for r in rows], "page_id long, url string, html string, host int, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(df).collect()]
    want = [(k, f"Body number {k}") for k in range(8)] + [(100 + k, "The same article") for k in range(9)] + [(200, "Subscribe to our daily letter")] * 2 + [(201, ""), (202, "")]
    assert sorted(got) == sorted((k, t, len(t)) for k, t in want)
    assert extract_pages(df.limit(0)).collect() == []


def test_html_counts_take_what_names_do_not_tell(spark):
    """Around the articles stand pieces of plain names and changing texts: what recurs by its skeleton goes, what does not stays."""
    rnd = random.Random(2)
    tags = [("div", f"k{k}") for k in range(12)] + [("section", f"s{k}") for k in range(6)]
    share = {t: rnd.choice([0.05, 0.3, 0.45, 0.55, 0.7, 0.95]) for t in tags}
    pages = []
    for k in range(260):
        host, section = rnd.choice(["a.org", "a.org", "b.org", "c.org"]) if k > 2 else "tiny.org", rnd.choice(["x", "y"])
        own = [t for t in tags if rnd.random() < share[t]]
        pages.append((k, host, section, own[: len(own) // 2], own[len(own) // 2 :]))
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, want, off = [], {}, {}
    for k, host, section, above, below in pages:
        said = {t: [word() for _ in range(rnd.randrange(1, 5))] for t in above + below}
        part = lambda ts, said=said: "".join(f"<{t} class={c}><ul>{''.join(f'<li><a href=/{x}>{x}</a></li>' for x in said[t, c])}</ul></{t}>" for t, c in ts)
        rows.append((k, f"http://{host}/{section}/{k}", f"<body>{part(above)}<article><h1>Title</h1><p>Text {k}</p><div class=k1><ul><li>kept {k}</li></ul></div></article>{part(below)}</body>"))
        near, far = [p for p in pages if p[1:3] == (host, section)], [p for p in pages if p[1] == host]
        gone = {t for t in said if any(sum(t in p[3] + p[4] for p in g) >= max(5, min(len(g) / 2, 50)) for g in (near, far))}
        blocks = lambda ts, gone, said=said: [x for t in ts if t not in gone for x in said[t]]
        body = ["Title", f"Text {k}", f"kept {k}"]
        want[k] = "\n\n".join(body if host == "tiny.org" else blocks(above, gone) + body + blocks(below, gone))
        off[k] = "\n\n".join(body if host == "tiny.org" else blocks(above, ()) + body + blocks(below, ()))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda **options: {r["page_id"]: r["text"] for r in extract_pages(df, **options).collect()}
    # a list's own skeleton recurs on nearly all pages, so lists go everywhere unless templates are off; a page of three on a host keeps to its article
    assert texts(many=50, min_pages=10**9) == off
    lists = {k: "\n\n".join(["Title", f"Text {k}", f"kept {k}"]) for k in want}
    assert texts(many=50) == lists and texts(many=50, hot=20) == lists


def test_html_skeletons_of_pieces(spark):
    """The same without lists inside the pieces, so that each piece is judged by its own count."""
    rnd = random.Random(6)
    names = [f"k{k}" for k in range(14)]
    share = {t: rnd.choice([0.05, 0.3, 0.45, 0.55, 0.7]) for t in names}
    pages = [(k, rnd.choice(["a.org", "a.org", "b.org"]), rnd.choice(["x", "y"]), [t for t in names if rnd.random() < share[t]]) for k in range(200)]
    rows, want = [], {}
    for k, host, section, own in pages:
        rows.append((k, f"http://{host}/{section}/{k}", f"<body><article><p>Text {k}</p></article>{''.join(f'<div class={t}>{t} on {k}</div>' for t in own)}</body>"))
        near, far = [p for p in pages if p[1:3] == (host, section)], [p for p in pages if p[1] == host]
        gone = {t for t in own if any(sum(t in p[3] for p in g) >= max(5, min(len(g) / 2, 60)) for g in (near, far))}
        want[k] = "\n\n".join([f"Text {k}", *(f"{t} on {k}" for t in own if t not in gone)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hot in (10, 40, 10**9):
        assert {r["page_id"]: r["text"] for r in extract_pages(df, many=60, hot=hot).collect()} == want


def test_html_templates_of_a_section_go_on_its_pages(spark):
    box = "<div class=x><p>Lisez notre lettre</p></div>"
    rows = [(k, f"http://h.com/fr/{k}", f"<body>{box}<div><p>Corps {k}</p></div></body>") for k in range(8)]
    rows += [(20 + k, f"http://h.com/en/{k}", f"<body><div><p>Body {k}</p></div></body>") for k in range(12)]
    rows += [(40, "http://h.com/en/40", f"<body>{box}</body>"), (41, "http://h.com/41", f"<body>{box}</body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_pages(df).collect()}
    assert got == {k: f"Corps {k}" for k in range(8)} | {20 + k: f"Body {k}" for k in range(12)} | {40: "Lisez notre lettre", 41: "Lisez notre lettre"}


def corpus(n=600):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        ws = [rnd.choice(["the", "a", "lane", "green", "walk", "stone", "you", "river"]) for _ in range(rnd.randrange(5, 80))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(3):
                ws[rnd.randrange(len(ws))] = rnd.choice(["idiot", "krazbug", "krazbugen", "krazbugt"])
        rows.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "idiot " * 20_000), (None, "you idiot"), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "s", 2) for i, t in rows], "doc_id long, text string, _scored string, predicted int")
    known = spark.createDataFrame([*labels, (7, None), (99999, 1)], "doc_id long, toxic int")
    got = toxic.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    import zlib

    score, truth = {r["doc_id"]: r["score"] for r in got}, dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = [score[i] for i in held if truth[i]], [score[i] for i in held if not truth[i]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxic.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxic.toxicity(docs.limit(0), none).collect() == []


def test_isotonic_is_the_best_rising_function():
    rng = np.random.default_rng(2)
    x, y = rng.random(60), rng.integers(0, 2, 60).astype(float)
    fit = toxic.Isotonic().fit(x, y)
    assert (np.diff(fit.y) >= 0).all() and (np.diff(fit.x) > 0).all()


def test_word_hashes_do_not_depend_on_where_a_word_stands():
    raw = "Idiot, an idiot! (IDIOT)".encode()
    w = toxic.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    keys = w.keys()
    assert keys[0] == keys[2] == keys[3] == toxic._key("idiot") and keys[1] != keys[0]
    assert hashlib.sha256(raw).hexdigest()
