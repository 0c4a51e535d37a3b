"""Compiled schemas against a plain validator, and redaction against a plain walk."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import contracts


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def even(v):
    """The value with numbers that are equal written alike."""
    if isinstance(v, dict):
        return {k: even(x) for k, x in v.items()}
    if isinstance(v, list):
        return [even(x) for x in v]
    return int(v) if kind(v) == "integer" else v


def plain(v, schema, root, path="$"):
    if "$ref" in schema:
        return plain(v, root["$defs"][schema["$ref"].split("/")[-1]], root, path)
    own, out = kind(v), []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if own not in kinds and not (own == "integer" and "number" in kinds):
            return [f"{path}: not {' or '.join(kinds)}, but {own}"]
    same = lambda a, b: type(a) is type(b) and a == b or kind(a) in ("integer", "number") and kind(b) in ("integer", "number") and a == b
    if "const" in schema and not same(v, schema["const"]):
        out.append(f"{path}: not {json.dumps(schema['const'])}")
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    tests = {
        "minLength": (own == "string", lambda n: len(v) < n, "shorter than minLength"), "maxLength": (own == "string", lambda n: len(v) > n, "longer than maxLength"), "pattern": (own == "string", lambda p: not re.search(p, v), "does not match pattern"),
        "minimum": (own in ("integer", "number"), lambda n: v < n, "below minimum"), "maximum": (own in ("integer", "number"), lambda n: v > n, "above maximum"),
        "minItems": (own == "array", lambda n: len(v) < n, "fewer than minItems"), "maxItems": (own == "array", lambda n: len(v) > n, "more than maxItems"),
        "uniqueItems": (own == "array", lambda on: on and len({json.dumps(even(x), sort_keys=True) for x in v}) < len(v), "items not unique"),
    }
    out += [f"{path}: {said}" for word, (is_it, wrong, said) in tests.items() if word in schema and is_it and wrong(schema[word])]
    if own == "array" and "items" in schema:
        out += [p for i, x in enumerate(v) for p in plain(x, schema["items"], root, f"{path}[{i}]")]
    if own == "object":
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}: missing {n}" for n in schema.get("required", []) if n not in v]
        out += [p for n, part in known.items() if n in v for p in plain(v[n], part, root, f"{path}.{n}")]
        for n in sorted(set(v) - set(known)):
            out += [f"{path}: unexpected {n}"] if more is False else plain(v[n], more, root, f"{path}.{n}") if isinstance(more, dict) else []
    return out


SCHEMA = {
    "$defs": {"score": {"type": "number", "minimum": 0, "maximum": 1}, "pair": {"type": "object", "required": ["left"], "properties": {"left": {"type": "integer"}, "right": {"type": ["integer", "null"]}, "score": {"$ref": "#/$defs/score"}}, "additionalProperties": False}},
    "type": "object", "required": ["engine", "pairs"],
    "properties": {"engine": {"enum": ["a", "b", 3]}, "version": {"const": 2}, "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"}, "pairs": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/pair"}}},
    "additionalProperties": {"type": "array", "items": {"type": "boolean"}},
}


def test_schemas_are_those_of_a_plain_validator(spark):
    rnd = random.Random(1)
    scalar = lambda: rnd.choice([None, True, 0, 1, 2, 3, 1.0, 0.5, -1, 1e3, "a", "b", "abc", "ABC", "toolong", "", "é"])
    pair = lambda: rnd.choice([scalar(), {"left": rnd.choice([1, 2, "x", 1.5]), **({"right": scalar()} if rnd.random() < 0.5 else {}), **({"score": scalar()} if rnd.random() < 0.5 else {}), **({"odd": 1} if rnd.random() < 0.2 else {})}, {}])
    docs = [scalar() for _ in range(10)] + [[], {}]
    for _ in range(300):
        d = {"engine": scalar(), "pairs": rnd.choice([scalar(), [pair() for _ in range(rnd.randrange(5))]])}
        for name in ("version", "name", "more", "other"):
            if rnd.random() < 0.4:
                d[name] = rnd.choice([scalar(), [True, scalar()], []])
        if rnd.random() < 0.1:
            del d["engine"]
        docs.append(d)
    docs += [{"engine": e, "pairs": [{"left": k, "right": None, "score": 0.5}], "name": "abc", "version": 2.0, "more": [False] * k} for k, e in enumerate(("a", "b", 3, 3.0))]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(-1, None)], "k int, d string")
    got = {r["k"]: r["p"] for r in df.select("k", contracts.problems(F.parse_json("d"), SCHEMA).alias("p")).collect()}
    assert got.pop(-1) is None
    for k, d in enumerate(docs):
        assert sorted(got[k]) == sorted(plain(d, SCHEMA, SCHEMA)), d
    assert sum(not p for p in got.values()) >= 4


def test_schemas_that_cannot_be_compiled():
    for bad in ({"oneOf": []}, {"properties": {"a": {"type": "date"}}}, {"items": {"$ref": "#/$defs/none"}}, {"$defs": {"a": {"if": {}}}}):
        with pytest.raises(ValueError):
            contracts.check_schema(bad)


def test_recursive_schemas_and_bounds(spark):
    tree = {"$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}}, "additionalProperties": False}}, "$ref": "#/$defs/node"}
    deep = lambda n: {"next": deep(n - 1)} if n else {}
    rows = [(0, deep(3)), (1, deep(30)), (2, {"next": {"next": {"x": 1}}})]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in rows], "k int, d string")
    got = {r["k"]: r["p"] for r in df.select("k", contracts.problems(F.parse_json("d"), tree).alias("p")).collect()}
    assert got[0] == [] and got[2] == ["$.next.next: unexpected x"] and len(got[1]) == 1 and got[1][0].endswith("nested too deep")
    plain = [({"a": ["x" * 5, "y"]}, []), ({"a": "x" * 9}, ["$.a: string too long"]), ([[1] * 4], ["$[0]: too many items"]), ([[[[1]]]], ["$[0][0][0][0]: nested too deep"]), (3, [])]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in enumerate(plain)], "k int, d string")
    got = {r["k"]: r["p"] for r in df.select("k", contracts.bounds(F.parse_json("d"), 3, 8, 3).alias("p")).collect()}
    assert [got[k] for k in range(len(plain))] == [p for _, p in plain]


def test_profiles(spark):
    good = {"schema_version": 1, "product_name": "p", "expected_roles": ["SERVICE"], "notes": {"any": [1]}}
    texts = [json.dumps(x) for x in (good, {**good, "extra": 1}, {**good, "schema_version": 2}, {**good, "product_name": "  "}, {**good, "expected_roles": ["NO"]}, {**good, "notes": "x" * 2000}, [1])] + ["{", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", contracts.profile(F.col("t")).alias("p")).collect()}
    assert (got[0]["problems"], got[0]["product_name"], got[0]["expected_roles"], got[0]["optional_roles"]) == ([], "p", ["SERVICE"], [])
    assert [got[k]["problems"][0] for k in range(1, 9)] == [
        "$: unexpected extra", "$.schema_version: not 1", "$.product_name: does not match pattern", "$.expected_roles[0]: not in enum", "$.notes: string too long", "$: not object, but array", "$: not JSON", "$: not JSON",
    ]
    assert all(got[k]["product_name"] is None for k in range(1, 9))


def test_redaction_reaches_every_string(spark):
    kind = T._parse_datatype_string("struct<a:string,n:int,l:array<struct<t:string,b:binary>>,m:map<string,array<string>>,deep:struct<x:struct<y:string>>,none:struct<z:string>>")
    row = ("mail me at a.b@c.org", 5, [("host 10.0.0.1", b"a@b.org"), None], {"x@y.org": ["1.2.3.4", None], "k": []}, (("z@z.org",),), None)
    df = spark.createDataFrame([(row,)], T.StructType([T.StructField("v", kind)]))
    out = df.select(contracts.redacted(F.col("v"), kind).alias("v"))
    v = out.first()["v"]
    assert out.schema["v"].dataType.simpleString() == kind.simpleString()
    assert v["a"] == "mail me at <mail>" and v["n"] == 5 and v["l"][0]["t"] == "host <address>" and v["l"][0]["b"] == b"a@b.org" and v["l"][1] is None
    two = spark.range(1).select(F.expr("map('x@y.org', 1, 'q@r.org', 2, 'k', 3)").alias("m"))
    assert two.select(contracts.redacted(F.col("m"), two.schema["m"].dataType).alias("m")).first()["m"] == {"<mail>": 2, "k": 3}
    assert v["m"] == {"<mail>": ["<address>", None], "k": []} and v["deep"]["x"]["y"] == "<mail>" and v["none"] is None
