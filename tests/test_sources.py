"""Files, documents and streams."""

import json
import struct

import pandas as pd
from pyspark.sql import functions as F

from strandline.operators import features, truth, versions
from strandline.sources import documents, files, results
from strandline.streaming import watch


def image(machine=0x8664, subsystem=2, flags=2, body=b""):
    head = bytearray(0x400)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, 0x84, machine, 1, 1_600_000_000, 0, 0, 240, flags)
    struct.pack_into("<H", head, 0x98, 0x20B)
    struct.pack_into("<H", head, 0x98 + 68, subsystem)
    struct.pack_into("<I", head, 0x98 + 108, 16)
    struct.pack_into("<8sIIII", head, 0x98 + 240, b".text", 0x1000, 0x1000, len(body), 0x400)
    return bytes(head) + body


def test_classes_of_files(spark, tmp_path):
    for name, data in {"a.sys": image(subsystem=1), "b.dll": image(flags=0x2002), "c.exe": image(), "d.ini": b"[a]\nx=1\n", "sub/e.bin": b"\0\1\2", "f.txt": "é".encode(), "h.exe": b"MZ"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["format"], r["role"]) for r in files.classified(files.discover(spark, str(tmp_path))).collect()}
    assert got == {
        "a.sys": ("PE32+", "KERNEL_DRIVER"), "b.dll": ("PE32+", "USER_MODULE"), "c.exe": ("PE32+", "EXECUTABLE"), "d.ini": ("TEXT", "CONFIGURATION"), "e.bin": ("UNKNOWN_BINARY", "OTHER"), "f.txt": ("TEXT", "DATA"), "h.exe": ("TEXT", "DATA"),
    }
    own = files.discover(spark, str(tmp_path))
    known = own.where("name = 'c.exe'").select(F.sha2("content", 256).alias("sha256"))
    assert files.stored(own, known).count() == 6
    empty = spark.createDataFrame([(b"", "x.ini")], "content binary, name string")
    assert tuple(files.classified(empty).select("format", "role", "confidence").first()) == ("UNKNOWN", "DATA", "LOW")


def test_facts_of_images(spark):
    data = image(body=b"some text here\0w\0i\0d\0e\0 \0t\0\0\0" + b"\0" * 64) + b"tail"
    df = spark.createDataFrame([(data,), (b"no image",), (b"",), (data[:0x120],)], "content binary")
    rows = df.select(files.image_facts("content").alias("f"), files.string_facts("content").alias("s"), files.hash_facts(F.col("content")).alias("h")).collect()
    f = rows[0]["f"]
    assert f["headers"]["machine"] == "x64" and f["headers"]["state"] == "MEASURED" and f["sections"]["value"][0]["name"] == ".text" and f["overlay"]["size"] == 4
    assert f["imports"]["value"] == [] and f["debug"]["pdb"] is None
    assert rows[1]["f"]["headers"]["state"] == "NOT_APPLICABLE"
    assert [(s["encoding"], s["value"]) for s in rows[0]["s"]["strings"] if s["offset"] >= 0x400] == [("ascii", "some text here"), ("utf-16le", "ewide t")]
    assert rows[2]["s"]["count"] == 0 and rows[2]["h"]["size_bytes"] == 0 and rows[0]["h"]["fuzzy_state"] == "NOT_MEASURED"


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_exports_become_features(spark, tmp_path):
    fn = lambda e, **k: {"entry": e, "name": f"FUN_{e}", "name_source": "DEFAULT", "size": 16, "thunk": False, "section": ".text", "blocks": [{"start": e, "size": 8, "succ": [e + 8]}, {"start": e + 8, "size": 8, "succ": []}], "insns": [["MOV", "REG,REG"], ["RET", ""]], "calls": [], "imports": [], "strings": [], "constants": ["18446744073709551615"]} | k
    good = {"format": "x", "status": "complete", "program": {"executable_sha256": "a" * 64, "blocks": [{"name": "t", "start": 0, "size": 64, "execute": True, "initialized": True}]}, "functions": [fn(16, calls=[32]), fn(32, name="run", name_source="USER")], "counts": {"functions": 2, "instructions": 4}}
    (tmp_path / "one.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "two.json").write_text(json.dumps(good | {"counts": {"functions": 3, "instructions": 1}}))
    (tmp_path / "three.json").write_text(json.dumps(good | {"status": "partial"}))
    own = documents.exports(spark, str(tmp_path))
    assert {r["component"]: r["problem"] for r in own.select("component", "problem").collect()} == {"one": None, "two": "count differs", "three": "incomplete"}
    f = documents.exported_functions(own)
    got = {r["entry"]: r for r in features.from_export(f).collect()}
    assert got[16]["name"] is None and got[16]["callee_names"] == ["run"] and got[32]["callers"] == [16] and got[16]["cyclomatic"] == 1
    assert got[16]["cfg_hash"] == got[32]["cfg_hash"] and got[16]["mnemonics"] == {"MOV": 1, "RET": 1} and got[16]["constants"] == ["18446744073709551615"]
    blocks = own.where("problem IS NULL").select("component", F.explode("program.blocks").alias("b")).select("component", "b.*")
    assert features.extraction_quality(blocks, f).first()["coverage"] == 0.5


def test_matcher_results_and_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"matches": {"0x10": {"right": "0x1f", "correlators": ["ExactBytes", "CallGraph", "New"]}}}))
    assert [tuple(r) for r in documents.matcher_pairs(spark, str(tmp_path / "m.json")).collect()] == [(16, 31, ["callgraph", "instruction"])]
    text = ["seen 2024-03-01", "123456789012345678 first", "223456789012345678", "05.02.2023 323456789012345678", "7 May 2022", "noise 12345", "123456789012345678 again 2020-01-01", "423456789012345678"]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(text)], "source string, pos int, line string")
    got = [(r["id"][0], str(r["day"])) for r in documents.manifest_list(df).collect()]
    assert got == [("1", "2024-03-01"), ("3", "2023-02-05"), ("2", "None"), ("4", "None")]
    t = spark.createDataFrame([("2024",), ("2024-05",), ("2024-05-06",), ("2024-05-06T07:08:09Z",), ("2024-05-06T07:08:09",), (None,)], "t string").select(documents.external_timestamp(F.col("t")).alias("x"))
    assert [r["x"]["precision"] for r in t.collect()] == ["YEAR", "MONTH", "DAY", "SECOND", "UNKNOWN", "UNKNOWN"]


def test_packs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (10, "a|"), (1, None)], "id long, v string")
    documents.write_pack({"t": (df, "id")}, str(tmp_path / "pack"))
    known = spark.createDataFrame([(2,)], "id long")
    assert sorted(r["id"] for r in documents.read_pack(spark, str(tmp_path / "pack"), "t", "id long, v string", known, "id").collect()) == [1, 10]
    text = documents.report_markdown(df, "Report")
    assert "| 10 | a\\| |" in text and "| 1 | UNKNOWN |" in text
    documents.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def run_stream(spark, tmp_path, df, schema, build, name, files=3):
    rows = df.toPandas()
    source = tmp_path / name
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(source))
    for k in range(files):
        part = rows.iloc[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_version_watch(spark, tmp_path):
    rows = [("a", 1, "f1", 2, False), ("a", 2, "f1", 2, False), ("a", 3, "f2", 2, True), ("a", 4, "f2", 2, False), ("b", 1, "", 0, False), ("a", 5, "f1", 1, False)]
    schema = "source string, seq long, fingerprint string, files int, locked boolean"
    got = run_stream(spark, tmp_path, spark.createDataFrame(rows, schema), schema, watch.version_watch, "scans")
    assert {(r["source"], r["seq"]): r["state"] for r in got} == {("a", 1): "NEW_VERSION", ("a", 2): "UNCHANGED", ("a", 3): "LOCKED", ("a", 4): "NEW_VERSION", ("b", 1): "EMPTY", ("a", 5): "NEW_VERSION"}


def test_streamed_baseline_equals_the_window(spark, tmp_path):
    rows = [("s", k, v) for k, v in enumerate([0.1, 0.11, 0.09, 0.1, 0.12, 0.1, 0.9, 0.1])]
    schema = "series string, seq long, value double"
    df = spark.createDataFrame(rows, schema)
    got = run_stream(spark, tmp_path, df, schema, watch.baseline_watch, "values_")
    want = versions.with_baseline(df.withColumnRenamed("value", "metric"), "series", "seq").collect()
    assert {(r["seq"], r["n_history"], r["class"]) for r in got} == {(r["seq"], r["n_history"], r["class"]) for r in want}


def test_streamed_windows(spark, tmp_path):
    at = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    rows = [(at(1), 1, "view"), (at(2), 1, "view"), (at(26), 2, "view"), (at(80), 1, "buy"), (at(1), 1, "late"), (at(160), 1, "buy")]
    schema = "ts timestamp, user_id long, event_type string"
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "user_id", "event_type"]), schema)
    got = run_stream(spark, tmp_path, df, schema, watch.event_counts, "counts", files=6)
    assert {(str(r["start"])[:10], r["event_type"], r["n"]) for r in got} == {("2024-01-01", "view", 2), ("2024-01-02", "view", 1), ("2024-01-04", "buy", 1)}
    got = run_stream(spark, tmp_path, df, schema, watch.sessions, "sessions_", files=6)
    assert {(r["user_id"], r["n"]) for r in got} >= {(1, 2), (2, 1)}


def test_matcher_databases(spark, tmp_path):
    import sqlite3

    base = sqlite3.connect(tmp_path / "a.db")
    base.execute("CREATE TABLE functionalgorithm (id INTEGER, name TEXT)")
    base.execute("CREATE TABLE function (address1 INTEGER, address2 INTEGER, similarity REAL, confidence REAL, algorithm INTEGER)")
    base.executemany("INSERT INTO functionalgorithm VALUES (?, ?)", [(1, "function: hash matching"), (2, "function: name hash matching"), (3, "function: address sequence"), (4, "function: Call Reference matching")])
    base.executemany("INSERT INTO function VALUES (?, ?, ?, ?, ?)", [(1, 11, 1.0, 1.0, 1), (2, 12, 1.0, 0.95, 2), (3, 13, 0.6, 0.7, 3), (4, 14, 0.6, 0.1, 4)])
    base.commit()
    base.close()
    (tmp_path / "b.db").write_bytes(b"no database")
    rows = results.matcher_databases(spark, str(tmp_path)).collect()
    got = {r["left"]: (r["right"], r["family"], r["decision"]) for r in rows if r["problem"] is None}
    assert got == {1: (11, "instruction", "EXACT"), 2: (12, "identity", "STRONG"), 3: (13, None, "PROBABLE"), 4: (14, "callgraph", "UNRESOLVED")}
    assert [r["decision"] for r in rows if r["problem"]] == [None]


def test_ground_truths_and_logical_functions(spark, tmp_path):
    t = {
        "versions": ["v1", "v2", "v3"], "components": ["c"], "functions": {"c": {"v1": {"f": 1, "g": 2, "h": 3}, "v2": {"f": 11, "g": 12}, "v3": {"f": 21, "g2": 22, "h": 23, "x": 24}}},
        "transitions": [
            {"component": "c", "from": "v1", "to": "v2", "pairs": [{"left": 1, "right": 11, "name": "f", "relation": "CONTINUATION"}], "splits": [], "merges": [{"lefts": [2], "right": 12}], "new": [], "disappeared": [{"left": 3, "name": "h"}]},
            {"component": "c", "from": "v2", "to": "v3", "pairs": [{"left": 11, "right": 21, "name": "f", "relation": "MODIFIED"}], "splits": [{"left": 12, "rights": [22]}], "merges": [], "new": [{"right": 23, "name": "h", "resurrects": {"version": "v1", "address": 3}}, {"right": 24, "name": "x", "resurrects": None}], "disappeared": []},
        ],
    }
    (tmp_path / "t.json").write_text(json.dumps(t, indent=1))
    truths = results.ground_truth(spark, str(tmp_path))
    fs = results.truth_functions(truths)
    assert fs.count() == 9
    relations = results.truth_relations(truths)
    assert sorted((r["kind"], r["from"], r["left"], r["right"]) for r in relations.collect()) == [("merge", "v1", 2, 12), ("pair", "v1", 1, 11), ("pair", "v2", 11, 21), ("return", "v1", 3, 23), ("split", "v2", 12, 22)]
    a, b = results.logical_edges(relations)
    v = F.concat_ws("|", "source", "component", "version", F.col("address").cast("string"))
    logical = truth.logical_functions(fs.select(v.alias("v")), relations.select(a.alias("a"), b.alias("b"))).collect()
    groups = {}
    for r in logical:
        groups.setdefault(r["logical"], set()).add(int(r["v"].split("|")[-1]))
    assert sorted(map(sorted, groups.values())) == [[1, 11, 21], [2, 12, 22], [3, 23], [24]]
    one = results.dataset_digest(spark, f"file:{tmp_path}").first()
    (tmp_path / "golden").mkdir()
    (tmp_path / "golden" / "r.json").write_text("{}")
    assert results.dataset_digest(spark, f"file:{tmp_path}").first() == one and one["n_files"] == 1


def test_key_value_texts(spark):
    rows = [('"a" { "b" "1" "c" { "d" "x \\"y\\" \\\\" } } "e" "2" "f"',), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(results.key_values(F.col("t"))).collect()]
    assert [g and json.loads(g) for g in got] == [{"a": {"b": "1", "c": {"d": 'x "y" \\'}}, "e": "2"}, {}, None]


def test_recorded_exports_are_never_verified(spark):
    exports = spark.createDataFrame([("aa", "complete")], "component string, status string")
    got = {r["sha256"]: (r["engine_version"], r["verified"], r["skip"]) for r in results.recorded(exports, spark.createDataFrame([("aa",), ("bb",)], "sha256 string")).collect()}
    assert got == {"aa": ("replay", False, None), "bb": (None, None, "SKIPPED_INCOMPATIBLE")}
