"""The package's queries on the smallest tables, and the pipeline against brute force."""

import pytest
from oracle import SF, same_rows

from strandline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.SQL[name])


def test_pipeline_keeps_clean_documents_and_drops_the_others(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rnd = random.Random(1)
    letters = "abcdefghij"
    word = lambda: "".join(rnd.choice(letters) for _ in range(5))
    text = lambda n: "\n".join(" ".join(word() for _ in range(8)) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(k, text(6)) for k in range(60)]
    bench = " ".join(word() for _ in range(20))
    labels = []
    for k in range(100, 160):
        docs.append((k, text(4) + " vilething " + text(1) + " vilethings vilething"))
        labels.append((k, 1))
    labels += [(k, 0) for k in range(60)]
    docs += [(200, docs[3][1].replace("\n", " ") + " more"), (201, "x " + bench.upper() + " y"), (202, None), (203, ""), (204, docs[5][1].split("\n", 3)[0] + "\n" + text(2)), (205, docs[7][1] + "\n" + text(4))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema)
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, kept = df, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder).cache()
        kept[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
        if name != "bpe":
            assert at.columns == df.columns
    clean = set(range(60))
    assert clean <= kept["bpe"] and {202, 203} <= kept["near dedup"] and 204 in kept["bpe"]
    assert not kept["toxicity"] & set(range(100, 160))
    assert 200 not in kept["near dedup"] and 205 in kept["bpe"] and 201 in kept["near dedup"] and 201 not in kept["benchmark decontamination"]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == kept["bpe"]
    import hashlib

    assert rows[1]["decoded_sha256"] == hashlib.sha256(docs[1][1].encode()).hexdigest()
    assert rows[205]["decoded_sha256"] == hashlib.sha256("\n".join(docs[-1][1].split("\n")[6:]).encode()).hexdigest()


def test_stages_of_nothing(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_is_a_plain_one(spark, tmp_path):
    """run() on the smallest tables and on planted rows, against loops over the stages' rules; the model's verdicts are its own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib

    from test_dedup import lines_brute, near_brute
    from test_text import hits_brute
    from tokenizers import Tokenizer

    from strandline.llm.common import table
    from strandline.llm.op2_bpe import vocabulary_path
    from strandline.llm.op9_toxicity import score, train

    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").limit(3).collect()
    passage = "\n".join(f"a line of the passage number {k} that stands in more than one text" for k in range(5))
    item = table(spark, SF, "benchmark").first()["text"]
    own = [(900_000, first[0]["text"] + " tail"), (900_001, None), (900_002, ""), (900_003, passage), (900_004, passage + "\nown end"), (900_005, f"before {item.upper()} behind"), (900_006, "short"), (900_007, "short")]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in own], docs.schema)
    both = docs.select(*corpus_pipeline.COLUMNS).unionByName(extra)
    folder = f"file://{tmp_path}"
    both.withColumn("near", both["text"]).write.parquet(f"{folder}/documents.parquet")  # one more column, which a stage has as well
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    at = {r["doc_id"]: r["text"] for r in both.collect()}
    clean = {r["doc_id"] for r in score(both, train(both, table(spark, SF, "labels"))).where("predicted = 0").select("doc_id").collect()}
    at = {i: t for i, t in at.items() if i in clean}
    at = {i: t for i, (t, _, gone) in lines_brute(list(at.items())).items() if not gone or t.strip(" ")}
    near = near_brute(list(at.items()))
    at = {i: t for i, t in at.items() if near[i][2]}
    hits = hits_brute(list(at.items()), [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])
    at = {i: t for i, t in at.items() if not hits[i][1]}
    library = Tokenizer.from_file(vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in at.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and 900_001 in got and 900_004 in got and not {900_003 if 900_004 not in got else 900_005, 900_007} & set(got)
