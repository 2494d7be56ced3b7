"""JSON payload rows of the log as typed tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.sources.log import role_rows


def entry_name(item: Column) -> Column:
    """The tool name of a payload item, NULL for an item that is no call.

    A bare string is a call without arguments; an object without a name is a
    call of the empty name. The common case, an object with a name, comes first.
    """
    kind = V.json_type(item)
    return F.coalesce(
        V.text(item, "name"),
        F.when(kind == "STRING", F.try_variant_get(item, "$", "string"))
        .when(kind.startswith("OBJECT"), ""))


def tool_entries(messages: DataFrame) -> DataFrame:
    """One row per recorded tool call: id, session_id, pos, name, args VARIANT.

    Payloads that are no JSON list, and items that are no call, give no rows.
    """
    item = F.col("item")
    return (
        role_rows(messages, C.TOOL_LOG)
        .select("id", "session_id",
                F.posexplode(V.elements(F.try_parse_json("content"))).alias("pos", "item"))
        .select("id", "session_id", "pos", entry_name(item).alias("name"),
                V.member(item, "arguments").alias("args"))
        .where(F.col("name").isNotNull())
    )


def tool_names(payload: Column) -> Column:
    """The distinct non-empty tool names of a payload, sorted."""
    names = F.transform(V.elements(payload), entry_name)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def turn_tool_names(messages: DataFrame) -> DataFrame:
    """Per tool row, its distinct names and their comma-joined text."""
    return (
        role_rows(messages, C.TOOL_LOG)
        .select("id", "session_id", tool_names(F.try_parse_json("content")).alias("tools"))
        .where(F.col("tools").isNotNull())
        .withColumn("tools_text", F.array_join("tools", ", "))
    )


def _rejection_structs(v: Column) -> Column:
    def rejection(item):
        return F.struct(
            F.try_variant_get(item, "$.attempt", "int").alias("attempt"),
            V.text(item, "response").alias("response"),
            V.text(item, "feedback").alias("feedback"),
            V.string_list(V.member(item, "tools_used")).alias("tools_used"),
        )

    objects = F.filter(V.elements(v), lambda item: V.fields(item).isNotNull())
    return F.coalesce(F.transform(objects, rejection), F.array())


def evaluator_entries(messages: DataFrame) -> DataFrame:
    """Grading rows of both shapes; rows that hold no JSON object are skipped.

    ``passed_is_false`` and ``has_user_message`` keep what the typed columns
    lose: a literal JSON false, and a message that is not empty. The payload is
    parsed in a generator, below which filters on its parts do not move, so it
    is parsed once however many there are.
    """
    v = F.col("v")
    return (
        role_rows(messages, C.EVALUATOR_LOG).where(V.begins_object(F.col("content")))
        .select("id", "session_id", "timestamp",
                F.explode(F.array(F.try_parse_json("content"))).alias("v"))
        .where(v.isNotNull())
        .select(
            "id", "session_id", "timestamp",
            V.whole_number(V.member(v, "attempts")).alias("attempts"),
            F.try_variant_get(v, "$.passed", "boolean").alias("passed"),
            F.try_variant_get(v, "$.max_retries_exceeded", "boolean")
            .alias("max_retries_exceeded"),
            V.text(v, "user_message").alias("user_message"),
            V.text(v, "final_response").alias("final_response"),
            _rejection_structs(V.member(v, "rejections")).alias("rejections"),
            V.is_false(V.member(v, "passed")).alias("passed_is_false"),
            V.truthy(V.member(v, "user_message")).alias("has_user_message"),
        )
    )


def rejections(evaluations: DataFrame) -> DataFrame:
    """One row per rejected draft."""
    return (
        evaluations.select("id", "session_id", F.explode("rejections").alias("r"))
        .select("id", "session_id", "r.attempt", "r.response", "r.feedback", "r.tools_used")
    )


def guard_blocks(messages: DataFrame) -> DataFrame:
    return role_rows(messages, C.GUARDRAIL_LOG).select(
        "id", "session_id", "timestamp",
        V.text(F.try_parse_json("content"), "reason").alias("reason"))


def tool_calls(completions: DataFrame, registry=None) -> DataFrame:
    """Calls in raw model messages: id, pos, call_id, name, args VARIANT, known, result.

    ``arguments`` is JSON text inside JSON. Calls of unregistered tools are kept
    with the result an unknown tool gives. ``registry`` lists (tool, argument,
    type, required) like ``TOOL_ARGUMENTS``; a longer list registers more tools.
    """
    tools = sorted({tool for tool, *_ in registry or C.TOOL_ARGUMENTS})
    call = F.col("call")
    return (
        completions
        .select("id", F.posexplode(V.elements(V.member(F.try_parse_json("completion"),
                                                       "tool_calls"))).alias("pos", "call"))
        .select("id", "pos",
                V.text(call, "id").alias("call_id"),
                F.coalesce(F.try_variant_get(call, "$.function.name", "string"),
                           F.lit("")).alias("name"),
                F.try_parse_json(F.try_variant_get(call, "$.function.arguments", "string"))
                .alias("args"))
        .withColumn("known", F.col("name").isin(tools))
        .withColumn("result", F.when(~F.col("known"),
                                     F.format_string("Unknown tool: %s", F.col("name"))))
    )


def _type_fits(kind: Column, expected: Column) -> Column:
    array_ok = (kind == "ARRAY<STRING>") | (kind == "ARRAY<VOID>")
    return (
        F.when(expected == "string", kind == "STRING")
        .when(expected == "integer", kind == "BIGINT")
        .when(expected == "array of string", array_ok)
        .otherwise(True)
    )


def _declarations(registry) -> Column:
    """The registry as a map literal from tool to its declared arguments."""
    by_tool = {}
    for tool, arg, kind, required in registry:
        by_tool.setdefault(tool, []).append(F.struct(
            F.lit(arg).alias("arg"), F.lit(kind).alias("type"),
            F.lit(required).alias("required")))
    return F.create_map(*[x for tool, args in by_tool.items()
                          for x in (F.lit(tool), F.array(*args))])


def arg_violations(calls: DataFrame, registry=None) -> DataFrame:
    """Calls of registered tools whose arguments break the declaration.

    ``id, pos, name, arg, violation`` with violation in missing, extra, type. The
    registry is part of the expression, so a much used tool is no hot join key.
    """
    given = F.coalesce(V.fields(F.col("args")),
                       F.create_map().cast("map<string,variant>"))

    def violation(arg, kind):
        return F.struct(arg.alias("arg"), F.lit(kind).alias("violation"))

    missing = F.transform(
        F.filter("declared", lambda d: d["required"]
                 & ~F.array_contains(F.map_keys("given"), d["arg"])),
        lambda d: violation(d["arg"], "missing"))
    extra = F.transform(
        F.array_except(F.map_keys("given"), F.transform("declared", lambda d: d["arg"])),
        lambda a: violation(a, "extra"))
    wrong = F.transform(
        F.filter("declared", lambda d: F.coalesce(
            ~_type_fits(V.json_type(F.col("given")[d["arg"]]), d["type"]), F.lit(False))),
        lambda d: violation(d["arg"], "type"))
    return (
        calls.withColumn("declared", F.try_element_at(
            _declarations(registry or C.TOOL_ARGUMENTS), F.col("name")))
        .where(F.col("declared").isNotNull())
        .withColumn("given", given)
        .select("id", "pos", "name", F.explode(F.concat(missing, extra, wrong)).alias("x"))
        .select("id", "pos", "name", "x.arg", "x.violation")
    )
