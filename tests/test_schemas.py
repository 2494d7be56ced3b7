"""Compiled schemas against a small checker."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import schemas

KINDS = {"string": str, "boolean": bool, "null": type(None), "object": dict, "array": list}


def is_number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def fits(x, kind):
    if kind == "number":
        return is_number(x)
    if kind == "integer":
        return is_number(x) and x == int(x)
    return isinstance(x, KINDS[kind])


def equal(x, y):
    if is_number(x) or is_number(y):
        return is_number(x) and is_number(y) and x == y
    return type(x) is type(y) and x == y


def checked(x, schema, path="$"):
    if schema is True:
        return []
    if schema is False:
        return [(path, "enum")]
    out = []
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(fits(x, k) for k in kinds):
        out.append((path, "type"))
    if "enum" in schema and not any(equal(x, y) for y in schema["enum"]):
        out.append((path, "enum"))
    if "const" in schema and not equal(x, schema["const"]):
        out.append((path, "const"))
    rules = [(is_number(x), "minimum", lambda n: x < n), (is_number(x), "maximum", lambda n: x > n),
             (is_number(x), "exclusiveMinimum", lambda n: x <= n),
             (is_number(x), "exclusiveMaximum", lambda n: x >= n),
             (isinstance(x, str), "minLength", lambda n: len(x) < n),
             (isinstance(x, str), "maxLength", lambda n: len(x) > n),
             (isinstance(x, str), "pattern", lambda p: not re.search(p, x)),
             (isinstance(x, list), "minItems", lambda n: len(x) < n),
             (isinstance(x, list), "maxItems", lambda n: len(x) > n)]
    out += [(path, word) for concerns, word, broken in rules
            if concerns and word in schema and broken(schema[word])]
    if isinstance(x, dict):
        out += [(f"{path}.{n}", "required") for n in schema.get("required", []) if n not in x]
        for name, value in x.items():
            if name in schema.get("properties", {}):
                out += checked(value, schema["properties"][name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append((f"{path}.{name}", "additionalProperties"))
            else:
                out += checked(value, schema.get("additionalProperties", True), f"{path}.{name}")
    if isinstance(x, list) and "items" in schema:
        for n, item in enumerate(x):
            out += checked(item, schema["items"], f"{path}[{n}]")
    return out


MEETING = {
    "type": "object", "title": "a meeting", "required": ["guest", "slots"],
    "additionalProperties": False,
    "properties": {
        "guest": {"type": "object", "required": ["email"], "additionalProperties": {"type": "integer"},
                  "properties": {"email": {"type": "string", "pattern": "@"},
                                 "age": {"type": "integer", "minimum": 18, "exclusiveMaximum": 120}}},
        "slots": {"type": "array", "minItems": 1, "maxItems": 2,
                  "items": {"type": ["object", "string"], "required": ["day"], "properties": {
                      "day": {"type": "string", "minLength": 2, "maxLength": 3},
                      "mode": {"enum": ["call", 1, None, True]}}}},
        "it's": {"const": 2.5}, "never": False, "any": True}}

scalar = st.one_of(st.none(), st.booleans(), st.integers(-200, 200), st.sampled_from(
    [1.0, 2.5, 17.999, 120.0, "", "a@b", "mé", "日本語", "longer", "call"]))
value = st.recursive(scalar, lambda x: st.one_of(
    st.lists(x, max_size=3),
    st.dictionaries(st.sampled_from(["guest", "slots", "email", "age", "day", "mode", "it's",
                                     "never", "any", "other"]), x, max_size=5)), max_leaves=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(value, st.fixed_dictionaries({"guest": value, "slots": value})),
                min_size=30, max_size=60))
def test_against_the_checker(spark, values):
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, values))), "id int, text string")
    got = {r.id: sorted((x.path, x.violation) for x in r.found) for r in rows.select(
        "id", schemas.violations(F.parse_json("text"), MEETING).alias("found")).collect()}
    assert got == {n: sorted(checked(x, MEETING)) for n, x in enumerate(values)}


def test_calls_and_unknown_keywords(spark):
    calls = spark.sql("""
        SELECT id, 0 AS pos, name, try_parse_json(text) AS args FROM VALUES
          (1, 'meet', '{"guest": {"email": "x"}, "slots": ["a", {"day": "x"}, 3]}'),
          (2, 'meet', 'no json'), (3, 'other', '{}'), (4, 'meet', NULL) AS t(id, name, text)""")
    got = sorted(tuple(r) for r in schemas.schema_violations(calls, {"meet": MEETING}).collect())
    assert got == [(1, 0, "meet", "$.guest.email", "pattern"), (1, 0, "meet", "$.slots", "maxItems"),
                   (1, 0, "meet", "$.slots[1].day", "minLength"),
                   (1, 0, "meet", "$.slots[2]", "type"), (2, 0, "meet", "$", "type"),
                   (4, 0, "meet", "$", "type")]
    with pytest.raises(ValueError, match="oneOf"):
        schemas.violations(F.col("args"), {"properties": {"a": {"oneOf": []}}})
    with pytest.raises(ValueError, match="date"):
        schemas.violations(F.col("args"), {"type": "date"})
