"""JSON schemas of tool arguments compiled to expressions over VARIANT.

A schema becomes one expression that gives the violations of a value with their JSON
paths, in the order of the schema; nested objects and lists are followed to any depth
the schema has, without a join or Python. Keywords: type (one or several), enum, const,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern
(found anywhere, Java syntax), properties, required, additionalProperties (a boolean or
a schema), items, minItems, maxItems. Others are refused when compiled, so that nothing
goes unchecked unnoticed, but for those that only describe.

As in JSON Schema 5.0 is an integer, true is none, and a rule for one type does not
concern values of another. Lengths count code points.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V

DESCRIBING = {"$schema", "$id", "title", "description", "default", "examples", "format"}
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<",
         "array": "ARRAY<"}
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
VIOLATIONS = "array<struct<path: string, violation: string>>"


def _number(value: Column) -> Column:
    """The value of a JSON number, NULL for anything else."""
    return F.when(V.json_type(value).rlike(NUMBER), F.try_variant_get(value, "$", "double"))


def _is(value: Column, kind: str) -> Column:
    if kind == "number":
        return V.json_type(value).rlike(NUMBER)
    if kind == "integer":
        return F.coalesce(_number(value) == F.floor(_number(value)), F.lit(False))
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind!r}")
    return V.json_type(value).startswith(KINDS[kind])


def _equals(value: Column, wanted) -> Column:
    if isinstance(wanted, str):
        return V.only_string(value) == wanted
    if wanted is None or isinstance(wanted, bool):
        return F.to_json(value) == {None: "null", True: "true", False: "false"}[wanted]
    if isinstance(wanted, (int, float)):
        return _number(value) == float(wanted)
    raise ValueError("enum and const take texts, numbers, booleans and null")


def _any(tests) -> Column:
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def _child(value: Column, name: str) -> Column:
    if "'" in name or "\\" in name:
        return F.try_element_at(V.fields(value), F.lit(name))
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _simple(value: Column, schema: dict) -> list[tuple[str, Column]]:
    """(keyword, is it broken) for the keywords that look at the value alone."""
    text, number, items = V.only_string(value), _number(value), V.elements(value)
    length, count = F.length(text), F.size(items)
    tests = {
        "enum": lambda x: ~_any([_equals(value, one) for one in x]),
        "const": lambda x: ~_any([_equals(value, x)]),
        "minimum": lambda x: number < x, "maximum": lambda x: number > x,
        "exclusiveMinimum": lambda x: number <= x, "exclusiveMaximum": lambda x: number >= x,
        "minLength": lambda x: length < x, "maxLength": lambda x: length > x,
        "pattern": lambda x: ~text.rlike(x),
        # a size of -1 or NULL is that of no list
        "minItems": lambda x: items.isNotNull() & (count < x),
        "maxItems": lambda x: items.isNotNull() & (count > x),
    }
    return [(word, tests[word](rule)) for word, rule in schema.items() if word in tests]


NESTED = {"type", "properties", "required", "additionalProperties", "items"}
SIMPLE = {"enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
          "minLength", "maxLength", "pattern", "minItems", "maxItems"}


def violations(value: Column, schema: dict | bool, path: Column | str = "$") -> Column:
    """The violations (path, violation) of a VARIANT that is not NULL, as an array."""
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast(VIOLATIONS)
    if schema is True:
        return none
    if schema is False:
        schema = {"enum": []}
    if unknown := set(schema) - DESCRIBING - NESTED - SIMPLE:
        raise ValueError(f"keywords that are not compiled: {sorted(unknown)}")

    def note(broken: Column, word: str, where: Column = path) -> Column:
        one = F.array(F.struct(where.alias("path"), F.lit(word).alias("violation")))
        return F.when(F.coalesce(broken, F.lit(False)), one.cast(VIOLATIONS)).otherwise(none)

    found = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        found.append(note(~_any([_is(value, k) for k in kinds]), "type"))
    if schema.get("enum") == []:
        found.append(note(F.lit(True), "enum"))
    else:
        found += [note(broken, word) for word, broken in _simple(value, schema)]
    declared, required = schema.get("properties", {}), schema.get("required", [])
    is_object = V.fields(value).isNotNull()
    for name in dict.fromkeys([*required, *declared]):
        child, where = _child(value, name), F.concat(path, F.lit(f".{name}"))
        absent = is_object & child.isNull()
        if name in required:
            found.append(note(absent, "required", where))
        if name in declared:
            found.append(F.when(child.isNotNull(), violations(child, declared[name], where))
                         .otherwise(none))
    more = schema.get("additionalProperties", True)
    if more is not True:
        known = F.array(*map(F.lit, declared)).cast("array<string>")
        extra = F.filter(F.map_entries(V.fields(value)),
                         lambda e: ~F.array_contains(known, e["key"]))

        def one_extra(entry):
            where = F.concat(path, F.lit("."), entry["key"])
            return (note(F.lit(True), "additionalProperties", where) if more is False
                    else violations(entry["value"], more, where))

        found.append(F.coalesce(F.flatten(F.transform(extra, one_extra)), none))
    if "items" in schema:
        def one_item(item, n):
            return violations(item, schema["items"],
                              F.concat(path, F.lit("["), n.cast("string"), F.lit("]")))

        found.append(F.coalesce(F.flatten(F.transform(V.elements(value), one_item)), none))
    return F.concat(*found) if found else none


def schema_violations(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """id, pos, name, path, violation of the calls (id, pos, name, args) of these tools.

    Arguments that are no JSON at all count as null.
    """
    args = F.coalesce("args", F.parse_json(F.lit("null")))
    found = F
    for tool, schema in schemas.items():
        found = found.when(F.col("name") == tool, violations(args, schema))
    return (
        calls.select("id", "pos", "name", F.explode(found).alias("x"))
        .select("id", "pos", "name", "x.path", "x.violation"))
