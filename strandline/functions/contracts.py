"""JSON schemas, bounds and redaction as column expressions, over VARIANT and over nested types.

A schema is compiled once, on the driver, to one expression that gives every problem of a document with
its path; nothing of it runs row by row in Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import sanitized

#: The keywords that a schema may use; the last line says nothing about values.
KEYWORDS = set(
    "$defs $ref type const enum required properties additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern minimum maximum"
    " $schema $id title description format default examples".split()
)
TYPES = ("object", "array", "string", "boolean", "null", "integer", "number")
#: How deep references may lead a document; what lies deeper is a problem.
DEPTH = 12


def _kind(v: Column) -> Column:
    """The JSON type of a variant; a number without a fraction is an integer."""
    name = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(F.is_variant_null(v), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(number == F.floor(number), "integer").otherwise("number")
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(wrong: Column, path: Column, said: str | Column) -> Column:
    text = F.lit(said) if isinstance(said, str) else said
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(path, F.lit(": "), text))).otherwise(_none())


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _facts(v: Column, f) -> Column:
    """f of what is asked of a variant again and again: a struct of v, kind, text, number, map and list, made once."""

    def own(x: Column) -> Column:
        return F.struct(x.alias("v"), _kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("text"), F.try_variant_get(x, "$", "double").alias("number"), _map(x).alias("map"), _list(x).alias("list"))

    return F.get(F.transform(F.transform(F.array(v), own), f), F.lit(0))


def _same(e: Column, value) -> Column:
    """Whether a variant is a JSON value; numbers are equal as numbers."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return e["kind"].isin("integer", "number") & (e["number"] == float(value))
    return F.to_json(e["v"]) == _json(value)


def check_schema(schema: dict, root: dict | None = None) -> None:
    """Refuse a schema with keywords or types that are not compiled, or references that lead nowhere."""
    root = schema if root is None else root
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
    if "$ref" in schema and schema["$ref"].removeprefix("#/$defs/") not in root.get("$defs", {}):
        raise ValueError(f"no such definition: {schema['$ref']}")
    kinds = schema.get("type", [])
    if set([kinds] if isinstance(kinds, str) else kinds) - set(TYPES):
        raise ValueError(f"no such type: {kinds}")
    for part in (*schema.get("properties", {}).values(), *schema.get("$defs", {}).values(), schema.get("items"), schema.get("additionalProperties")):
        if isinstance(part, dict):
            check_schema(part, root)


def problems(v: Column, schema: dict) -> Column:
    """All problems of a variant, as texts `path: what`, in the order of the schema's keywords and the document's
    places; null for a null document. `$` is the document."""
    check_schema(schema)
    return F.when(v.isNotNull(), _problems(v, schema, schema, F.lit("$"), DEPTH))


def _problems(v: Column, schema: dict, root: dict, path: Column, depth: int) -> Column:
    if depth < 0:
        return _if(F.lit(True), path, "nested too deep")
    if "$ref" in schema:
        return _problems(v, root["$defs"][schema["$ref"].removeprefix("#/$defs/")], root, path, depth - 1)
    return _facts(v, lambda e: _found(e, schema, root, path, depth))


def _found(e: Column, schema: dict, root: dict, path: Column, depth: int) -> Column:
    kind = e["kind"]
    found: list[Column] = []
    if "const" in schema:
        found.append(_if(~_same(e, schema["const"]), path, f"not {_json(schema['const'])}"))
    if "enum" in schema:
        any_of = F.lit(False)
        for value in schema["enum"]:
            any_of = any_of | F.coalesce(_same(e, value), F.lit(False))
        found.append(_if(~any_of, path, "not in enum"))
    text, number, items, fields = e["text"], e["number"], e["list"], e["map"]
    is_text, is_number, is_list, is_object = kind == "string", kind.isin("integer", "number"), kind == "array", kind == "object"
    for word, is_it, wrong, said in (
        ("minLength", is_text, lambda n: F.length(text) < n, "shorter than minLength"), ("maxLength", is_text, lambda n: F.length(text) > n, "longer than maxLength"), ("pattern", is_text, lambda p: ~text.rlike(p), "does not match pattern"),
        ("minimum", is_number, lambda n: number < n, "below minimum"), ("maximum", is_number, lambda n: number > n, "above maximum"),
        ("minItems", is_list, lambda n: F.size(items) < n, "fewer than minItems"), ("maxItems", is_list, lambda n: F.size(items) > n, "more than maxItems"),
        ("uniqueItems", is_list, lambda on: F.lit(on) & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items)), "items not unique"),
    ):
        if word in schema:
            found.append(_if(is_it & wrong(schema[word]), path, said))
    if isinstance(schema.get("items"), dict):
        each = F.transform(items, lambda x, i: _problems(x, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth - 1))
        found.append(F.when(is_list, F.flatten(each)).otherwise(_none()))
    has = lambda name: F.coalesce(F.map_contains_key(fields, name), F.lit(False))
    for name in schema.get("required", []):
        found.append(_if(is_object & ~has(name), path, f"missing {name}"))
    known = schema.get("properties", {})
    for name, part in known.items():
        below = _problems(F.try_element_at(fields, F.lit(name)), part, root, F.concat(path, F.lit(f".{name}")), depth - 1)
        found.append(F.when(is_object & has(name), below).otherwise(_none()))
    more = schema.get("additionalProperties", True)
    if more is not True:
        other = F.filter(F.map_entries(fields), lambda x: ~x["key"].isin(*known) if known else F.lit(True))
        place = lambda x: F.concat(path, F.lit("."), x["key"])
        below = F.transform(other, lambda x: _if(F.lit(True), path, F.concat(F.lit("unexpected "), x["key"])) if more is False else _problems(x["value"], more, root, place(x), depth - 1))
        found.append(F.when(is_object, F.flatten(below)).otherwise(_none()))
    out = F.concat(*found) if found else _none()
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = kind.isin(*kinds, *(["integer"] if "number" in kinds else []))
        out = F.when(fits, out).otherwise(F.array(F.concat(path, F.lit(f": not {' or '.join(kinds)}, but "), kind)))
    return out


def bounds(v: Column, depth: int = 4, length: int = 1024, items: int = 256) -> Column:
    """Problems of a variant's size, wherever they are: nesting, strings and lists beyond the bounds."""
    return F.when(v.isNotNull(), _bounds(v, F.lit("$"), depth, length, items))


def _bounds(v: Column, path: Column, depth: int, length: int, items: int) -> Column:
    if depth < 0:
        return _if(F.lit(True), path, "nested too deep")
    return _facts(v, lambda e: _bounds_of(e, path, depth, length, items))


def _bounds_of(e: Column, path: Column, depth: int, length: int, items: int) -> Column:
    own = F.concat(_if((e["kind"] == "string") & (F.length(e["text"]) > length), path, "string too long"), _if((e["kind"] == "array") & (F.size(e["list"]) > items), path, "too many items"))
    place = lambda p, x: F.struct(p.alias("path"), x.alias("value"))
    listed = F.transform(e["list"], lambda x, i: place(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x))
    named = F.transform(F.map_entries(e["map"]), lambda x: place(F.concat(path, F.lit("."), x["key"]), x["value"]))
    below = F.when(e["kind"] == "array", listed).when(e["kind"] == "object", named)
    return F.concat(own, F.coalesce(F.flatten(F.transform(below, lambda x: _bounds(x["value"], x["path"], depth - 1, length, items))), _none()))


#: The profile of a product: closed keys, a known version, a name that is not blank, lists of roles.
ROLES = ("KERNEL_DRIVER", "SERVICE", "USER_MODULE", "EXECUTABLE", "LIBRARY", "CONFIGURATION", "OTHER")
PROFILE = {
    "type": "object", "required": ["schema_version", "product_name"], "additionalProperties": False,
    "properties": {
        "schema_version": {"const": 1}, "product_name": {"type": "string", "pattern": r"\S"}, "notes": {}, "expected_roles": {"type": "array", "items": {"enum": list(ROLES)}}, "optional_roles": {"type": "array", "items": {"enum": list(ROLES)}},
    },
}


def profile(text: Column) -> Column:
    """struct(problems, product_name, expected_roles, optional_roles) of a profile's JSON text; a profile with
    problems has no fields, and neither has what is no JSON."""
    v = F.try_parse_json(text)
    wrong = F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(F.concat(problems(v, PROFILE), bounds(v)))
    ok = F.size(wrong) == 0
    roles = lambda name: F.when(ok, F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), _none()))
    return F.struct(wrong.alias("problems"), F.when(ok, F.try_variant_get(v, "$.product_name", "string")).alias("product_name"), roles("expected_roles").alias("expected_roles"), roles("optional_roles").alias("optional_roles"))


def redacted(value: Column, kind: T.DataType, clean=sanitized) -> Column:
    """A value of any nested type with every string in it cleaned, keys of maps too; of keys that become equal the
    last one's value stays. What holds no string is left as it is."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return clean(value)
    if not _holds_strings(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, clean))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(redacted(e["key"], kind.keyType, clean).alias("key"), redacted(e["value"], kind.valueType, clean).alias("value")))
        last = lambda own: F.filter(own, lambda e, i: F.size(F.filter(own, lambda o, j: (j > i) & o["key"].eqNullSafe(e["key"]))) == 0)
        return F.map_from_entries(last(pairs))
    return F.when(value.isNotNull(), F.struct(*(redacted(value[f.name], f.dataType, clean).alias(f.name) for f in kind.fields)))


def _holds_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_strings(kind.keyType) or _holds_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_strings(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
