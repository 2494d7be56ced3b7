"""Typed reads of open-shaped JSON held as VARIANT.

The payloads carry values whose JSON type matters (``5`` is a rating, ``"5"``
and ``5.0`` are not), so values stay VARIANT until a typed getter below.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def begins_object(text: Column) -> Column:
    """Can the text be a JSON object: its first character that is no space is {."""
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def elements(v: Column) -> Column:
    """The items of a JSON list, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column) -> Column:
    """The members of a JSON object, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def member(v: Column, name: str) -> Column:
    """One member as VARIANT; NULL if absent or if ``v`` is no object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column, name: str) -> Column:
    """One member as text, NULL if absent or JSON null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def text_or(v: Column, name: str, default: str) -> Column:
    """One member as text; the default only if absent, NULL for JSON null."""
    return F.when(member(v, name).isNull(), F.lit(default)).otherwise(text(v, name))


def json_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def only_string(v: Column) -> Column:
    """The value of a JSON string, NULL for any other type."""
    return F.when(json_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


FALSY = ['""', "null", "false", "0", "0.0", "-0.0", "[]", "{}"]


def truthy(v: Column) -> Column:
    """Neither absent, null, false, zero, nor an empty string, list or object."""
    return F.coalesce(~F.to_json(v).isin(FALSY), F.lit(False))


def integer(v: Column) -> Column:
    """A JSON integer, or a boolean as 1/0; NULL for ``5.0``, ``"5"`` and the rest."""
    return F.when(json_type(v).isin("BIGINT", "BOOLEAN"),
                  F.try_variant_get(v, "$", "bigint"))


def whole_number(v: Column) -> Column:
    """A JSON number rounded toward zero; NULL for text, booleans and the rest."""
    is_number = json_type(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(is_number, F.try_variant_get(v, "$", "bigint"))


def is_true(v: Column) -> Column:
    """JSON ``true`` itself, not a value that merely converts to it."""
    return F.coalesce(F.to_json(v) == "true", F.lit(False))


def is_false(v: Column) -> Column:
    return F.coalesce(F.to_json(v) == "false", F.lit(False))


def string_list(v: Column) -> Column:
    """The string items of a JSON list, NULL for anything else."""
    return F.filter(F.transform(elements(v), only_string), lambda x: x.isNotNull())


def text_list(v: Column) -> Column:
    """All items of a JSON list as text, in order, none dropped."""
    return F.transform(elements(v), lambda x: F.coalesce(
        F.try_variant_get(x, "$", "string"), F.to_json(x)))
