"""Token alignment against plain loops over the libraries' tokens."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import op12_token_alignment as op12
from strandline.llm.op12_token_alignment import A, B, NONE, Sweep, align, piece_path
from strandline.llm.op2_bpe import vocabulary_path

SCHEMA = "doc_id long, text string, key string, n_a string, side string"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=piece_path())


def brute(rows, libraries):
    """rows: (id, text); the result rows, and the pair counts."""
    a, b = libraries
    ranks = {int(i): base64.b64decode(t) for t, i in map(str.split, open(vocabulary_path().replace(".json", ".tiktoken")))}
    out, counts = [], Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt_a = [ranks[x] for x in ids_a]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        want = (" " + (text or "")).encode()
        if not text or b"".join(spelt_a) != want or b"".join(spelt_b) != want:
            out.append((i, 0, 0, [], []))
            continue
        ends = []
        for spelt in (spelt_a, spelt_b):
            ends.append(np.cumsum([len(x) for x in spelt]).tolist())
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, x, y, links = [], 0, 0, []
        for e in both:
            p, q = ends[0].index(e, x) + 1, ends[1].index(e, y) + 1
            groups.append(",".join(map(str, ids_a[x:p])) + "|" + ",".join(map(str, ids_b[y:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            x, y = p, q
        counts.update(links)
        out.append((i, len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (i, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, na, nb, g, ls in out
    ], counts


def texts():
    rnd = random.Random(3)
    words = "the of data Ärger naïve 東京タワー don't <|endoftext|> </s> <0x0A> 3.14159 x2   ﬁne é emoji👩‍👩‍👧 ... ==== \t \n\n  ".split(" ") + ["\n", "\t", "　"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(120)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x4E00, 0x5000), 0x1F600])) for _ in range(40)) for _ in range(60)]
    out += ["", " ", "  ", "a", " a", "a ", "a  b", "a▁b", "▁", "\u0000", "aaaa" * 500, "\n" * 300, " " * 100 + "x"]
    return out + [" ".join(out) * 4, "word " * 30_000, "東京" * 40_000]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_is_that_of_plain_loops(spark, libraries, small, monkeypatch):
    rows = [*enumerate(texts()), (900, None), (None, "null id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, "k", "n", "s") for i, t in rows], SCHEMA)
    want, counts = brute(rows, libraries)
    out, pairs = align(df, pairs=50 if small else op12.PAIRS)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(counts)
    most = {y: max(n for (_, z), n in counts.items() if z == y) for _, y in counts}
    assert all(r["best"] == (r["n"] == most[r["b"]]) for r in pairs.collect())
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_nothing(spark):
    out, pairs = align(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and pairs.collect() == []
    out, pairs = align(spark.createDataFrame([(1, None, "", "", ""), (1, "", "", "", "")], SCHEMA))
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2 and pairs.collect() == []


def test_the_sweep_gives_the_same_however_its_input_is_cut():
    rng = random.Random(5)
    sizes = np.array([1, 2, 3, 4]), np.array([1, 2, 5])
    rows = []
    for key in range(60):
        if key % 7 == 0:
            rows.append((key, f"d{key}", NONE, None))
            continue
        for stretch in range(rng.randrange(1, 4)):
            total, sides = rng.randrange(1, 40), []
            for size in sizes:
                ids, left = [], total
                while left:
                    x = rng.choice([k for k, n in enumerate(size) if n <= left])
                    ids.append(x)
                    left -= size[x]
                sides.append(np.array(ids))
            if stretch == 1:  # a token of each side belongs to the stretch before, so that a group spans both
                rows[-2] = (*rows[-2][:3], np.append(rows[-2][3], 1))
                sides[B] = np.append([1], sides[B])
            rows += [(key, f"d{key}", A, sides[A]), (key, f"d{key}", B, sides[B])]

    def run(cut):
        machine, got = Sweep(*sizes), {}
        for k in range(0, len(rows), cut) or [0]:
            for r in machine.run(rows[k : k + cut], k + cut >= len(rows)):
                codes, times = np.frombuffer(r["codes"], "<u4"), np.frombuffer(r["times"], "<u4")
                old = got.setdefault(r["key"], [r["doc_id"], 0, 0, 0, "", Counter()])
                old[1:4] = [x + y for x, y in zip(old[1:4], (r["n_a"], r["n_b"], r["n_groups"]))]
                old[4] += r["groups_sha256"]
                old[5].update(dict(zip(codes.tolist(), times.tolist())))
        return got, dict(zip(*(x.tolist() for x in machine.counts())))

    whole = run(len(rows))
    assert len(whole[0]) == 60
    for cut in (1, 2, 3, 10):
        assert run(cut) == whole
