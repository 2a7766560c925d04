"""Compiled JSON Schemas against a plain validator of the same keywords."""

import json
import random
import re

import pytest

from plumeria.operators import schema_rules as s
from plumeria.schemas import DATA_JSON_SCHEMA, LOOKUP_JSON_SCHEMA


def kinds(v):
    if v is None:
        return {"null"}
    if isinstance(v, bool):
        return {"boolean"}
    if isinstance(v, int):
        return {"integer", "number"}
    if isinstance(v, float):
        return {"number", "integer"} if v.is_integer() else {"number"}
    return {"string"} if isinstance(v, str) else {"array"} if isinstance(v, list) else {"object"}


def broken(v, schema, at):
    """Names of the rules that a value breaks, by recursion over the value."""
    out = set()
    allowed = schema.get("type")
    if allowed and not kinds(v) & ({allowed} if isinstance(allowed, str) else set(allowed)):
        out.add(f"{at}: type")
    if "enum" in schema and v not in schema["enum"]:
        out.add(f"{at}: enum")
    checks = {"pattern": lambda x: not re.search(x, v), "minLength": lambda x: len(v) < x, "maxLength": lambda x: len(v) > x} if isinstance(v, str) else {}
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        checks = {"minimum": lambda x: v < x, "maximum": lambda x: v > x, "exclusiveMinimum": lambda x: v <= x, "exclusiveMaximum": lambda x: v >= x}
    if isinstance(v, list):
        checks = {"minItems": lambda x: len(v) < x, "maxItems": lambda x: len(v) > x, "uniqueItems": lambda x: x and len(set(map(str, v))) < len(v)}
        for item in v:
            out |= broken(item, schema.get("items", {}), f"{at}[]")
    out |= {f"{at}: {k}" for k, f in checks.items() if k in schema and f(schema[k])}
    if isinstance(v, dict):
        out |= members(v, schema, f"{at}.")
    for k, end in (("anyOf", all), ("allOf", any)):
        if k in schema and end(broken(v, x, at) for x in schema[k]):
            out.add(f"{at}: {k}")
    if "not" in schema and not broken(v, schema["not"], at):
        out.add(f"{at}: not")
    return out


def members(v, schema, at=""):
    out = {f"{at}{n}: required" for n in schema.get("required", ()) if n not in v}
    for n, x in v.items():
        if n in schema.get("properties", {}):
            if x is not None or n in schema.get("required", ()):  # null stands for an absent field
                out |= broken(x, schema["properties"][n], f"{at}{n}")
        elif schema.get("additionalProperties", True) is False and x is not None:
            out.add(f"{at}{n}: additionalProperties")
    return out


SCHEMA = {
    "type": "object", "required": ["a", "b", "gone"], "additionalProperties": False,
    "properties": {
        "a": {"type": "string", "pattern": "^[a-c]+$", "minLength": 2, "maxLength": 4}, "b": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 5}, "c": {"type": "number", "exclusiveMinimum": 0, "maximum": 2},
        "d": {"type": "integer"}, "e": {"enum": ["x", "", None]}, "f": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "pattern": "b"}},
        "g": {"type": "object", "required": ["u"], "additionalProperties": False, "properties": {"u": {"type": "integer", "minimum": 0}, "w": {"type": "array", "items": {"type": "object", "properties": {"z": {"enum": [1, 2]}}}}}},
        "h": {"anyOf": [{"pattern": "^p"}, {"pattern": "q$"}], "not": {"pattern": "r"}}, "i": {"allOf": [{"minimum": 0}, {"maximum": 3}]}, "j": {"type": "boolean"},
    },
}
TABLE = "a string, b int, c double, d double, e string, f array<string>, g struct<u:int,w:array<struct<z:int>>,v:string>, h string, i int, j string, extra string, violations int"


def test_like_a_plain_validator(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = []
    for _ in range(400):
        g = None if rng.random() < 0.2 else {"u": pick(None, -1, 3), "w": pick(None, [], [{"z": 1}, {"z": 3}], [{"z": None}]), "v": pick(None, "v")}
        rows.append({"a": pick(None, "ab", "a", "abcab", "xy"), "b": pick(None, 0, 1, 5), "c": pick(None, 0.0, 1.5, 9.0), "d": pick(None, 2.0, 2.5), "e": pick(None, "x", "", "y"), "f": pick(None, [], ["b"], ["b", "b"], ["a", None], ["b", "ab", "bc", "bd"]), "g": g, "h": pick(None, "p", "qq", "z", "pr"), "i": pick(None, -1, 2, 4), "j": pick(None, "true"), "extra": pick(None, "e")})
    df = spark.createDataFrame([{**r, "violations": 1} for r in rows], TABLE)
    got = [set(r.violations) for r in s.conform(df, SCHEMA).collect()]
    assert got == [members(r, SCHEMA) for r in rows]
    counts = {r.rule: r.n for r in s.broken_rules(s.conform(df, SCHEMA)).collect()}
    assert counts["gone: required"] == 400 and "g.w[].z: enum" in counts


@pytest.mark.parametrize("schema", [LOOKUP_JSON_SCHEMA, DATA_JSON_SCHEMA])
def test_file_schemas_compile(spark, schema, tmp_path):
    """From a file, for a table of the right types: a good row breaks nothing, and each field left out is missing."""
    (tmp_path / "s.json").write_text(json.dumps(schema))
    schema = s.load_schema(spark, str(tmp_path / "s.json"))
    good = {"string": "x", "integer": 5, "number": 0.5, "boolean": True, "array": ["A-2020-0001-1"]}
    row = {}
    for name, p in schema["items"]["properties"].items():
        kind = p["type"] if isinstance(p["type"], str) else p["type"][0]
        row[name] = p["enum"][0] if "enum" in p else "AB-2020-0001-1" if "pattern" in p else good[kind]
    df = spark.createDataFrame([row])
    assert s.conform(df, schema).first().violations == []
    for name in row:
        assert s.conform(df.drop(name), schema).first().violations == [f"{name}: required"]


def test_unknown_keywords_are_refused(spark):
    with pytest.raises(s.SchemaError):
        s.violations(spark.createDataFrame([("a",)], "a string").schema, {"properties": {"a": {"patternn": "x"}}})


def test_empty_table(spark):
    assert s.conform(spark.createDataFrame([], "a string"), LOOKUP_JSON_SCHEMA).count() == 0
