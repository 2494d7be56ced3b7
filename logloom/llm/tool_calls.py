"""Linking of tool calls and results, argument checks, canonical JSON.

Messages have conv_id, turn, role, text, calls (array of id, name, arguments) and
result_for, the id of the call that the message answers. Calls and results are
hash-joined by conversation and identifier. A call may take the result of another as
an argument, written ``"$id"``. Turns are in order already; calls of one turn are
ordered by level, one above the highest of the calls of that turn that they refer to.
A result that was logged before its call comes right after the call.

Events stay rows, so a conversation of any length is never gathered; their order is
(conv_id, turn, step, at, part). Each carries canonical JSON: keys sorted, no spaces.

Problems of a call: ``repeated id`` (the conversation has an earlier call of it),
``no id``, ``no result``, ``no object`` (arguments that are no JSON object),
``unknown tool``, ``missing p``, ``extra p``, ``type p``, ``reference id`` (no call
of that id in this or an earlier turn), ``cycle``. Of a result: ``no call``,
``repeated result``.

Null texts and arguments are JSON null, null calls none. A null conv_id is one
conversation. Repeated rows are repeated messages; of calls or results of one id the
first by turn and place links, those that tie with it as well. No rows give no rows;
other columns are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.llm.common import stored

PLACES = 1 << 31
WHOLE = {"ignoreNullFields": "false"}


def _on(left: str, right: str, *columns: str) -> Column:
    return F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in columns))


def calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, at, call_id, name, args (VARIANT), place."""
    return messages.select("conv_id", "turn", F.posexplode("calls").alias("at", "call")).select(
        "conv_id", F.col("turn").cast("bigint"), "at", F.col("call.id").alias("call_id"),
        F.col("call.name").alias("name"), F.try_parse_json("call.arguments").alias("args"),
        (F.col("turn") * F.lit(PLACES) + F.col("at")).alias("place"))


def results(messages: DataFrame) -> DataFrame:
    return messages.where("result_for IS NOT NULL").select(
        "conv_id", F.col("turn").cast("bigint"), F.col("result_for").alias("call_id"), "role",
        "text")


def firsts(rows: DataFrame, value: str) -> DataFrame:
    """The least ``value`` per conversation and call id."""
    return (rows.where("call_id IS NOT NULL").groupBy("conv_id", "call_id")
            .agg(F.min(value).alias("first")))


def _kind_fits(kind: Column, expected: Column) -> Column:
    return (F.when(expected == "string", kind == "STRING")
            .when(expected == "integer", kind == "BIGINT")
            .when(expected == "number", kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"))
            .when(expected == "boolean", kind == "BOOLEAN")
            .when(expected == "array", kind.startswith("ARRAY"))
            .otherwise(kind.startswith("OBJECT")))


def argument_problems(name: Column, args: Column, schemas) -> Column:
    """What is wrong with the arguments of one call, as an array of texts.

    ``schemas`` lists (tool, parameter, type, required); it is part of the
    expression, so a much used tool is no hot join key.
    """
    by_tool = {}
    for tool, parameter, kind, required in schemas:
        by_tool.setdefault(tool, []).append(F.struct(
            F.lit(parameter).alias("p"), F.lit(kind).alias("kind"),
            F.lit(required).alias("required")))
    declared = F.try_element_at(F.create_map(*[
        x for tool, rows in by_tool.items() for x in (F.lit(tool), F.array(*rows))]), name)
    given = V.fields(args)

    def named(rows, what):
        return F.transform(rows, lambda d: F.concat(F.lit(what + " "), d["p"]))

    missing = F.filter(declared, lambda d: d["required"]
                       & ~F.array_contains(F.map_keys(given), d["p"]))
    wrong = F.filter(declared, lambda d: F.coalesce(
        ~_kind_fits(V.json_type(given[d["p"]]), d["kind"]), F.lit(False)))
    extra = F.transform(
        F.array_except(F.map_keys(given), F.transform(declared, lambda d: d["p"])),
        lambda p: F.concat(F.lit("extra "), p))
    return (F.when(declared.isNull(), F.array(F.lit("unknown tool")))
            .when(given.isNull(), F.array(F.lit("no object")))
            .otherwise(F.concat(named(missing, "missing"), F.array_sort(extra),
                                named(wrong, "type"))))


def references(called: DataFrame) -> DataFrame:
    """conv_id, turn, place, target: ids that the arguments of a call name."""
    values = F.map_values(V.fields(F.col("args")))
    return called.select("conv_id", "turn", "place", F.explode(F.array_distinct(
        F.transform(values, V.only_string))).alias("target")) \
        .where(F.col("target").startswith("$")) \
        .withColumn("target", F.expr("substring(target, 2)"))


def levels(edges: DataFrame) -> DataFrame:
    """conv_id, place, level of calls with edges to calls of their turn; null in cycles.

    Every round settles the calls that wait for no unsettled call. There are as many
    rounds as the longest chain within one message, which is small.
    """
    open_edges, done, level = stored(edges, "calls-edges0"), [], 0
    while not open_edges.isEmpty():
        level += 1
        sources = open_edges.select("conv_id", F.col("place").alias("_source")).distinct()
        waiting = (open_edges.alias("e").join(sources.alias("s"), F.expr(
            "e.conv_id <=> s.conv_id AND e.target_place = s._source"), "left_semi")
            .select("conv_id", "place").distinct())
        settled = stored(
            open_edges.select("conv_id", "place").distinct().alias("e")
            .join(waiting.alias("w"), _on("e", "w", "conv_id", "place"), "left_anti")
            .withColumn("level", F.lit(level)), f"calls-level{level}")
        if settled.isEmpty():
            done.append(open_edges.select("conv_id", "place").distinct()
                        .withColumn("level", F.lit(None).cast("int")))
            break
        done.append(settled)
        open_edges = stored(
            open_edges.alias("e").join(settled.alias("s"), _on("e", "s", "conv_id", "place"),
                                       "left_anti"), f"calls-edges{level}")
    none = edges.select("conv_id", "place", F.lit(0).alias("level")).where("false")
    return reduce(DataFrame.unionByName, done, none)


def linked(messages: DataFrame, schemas) -> DataFrame:
    """Calls with their problems, level and whether a result links."""
    called = calls(messages)
    first_call = firsts(called, "place")
    first_result = firsts(results(messages), "turn")
    refs = (references(called).alias("r")
            .join(first_call.alias("c"),
                  F.expr("r.conv_id <=> c.conv_id AND r.target = c.call_id"), "left")
            .select("r.*", F.col("c.first").alias("target_place")))
    refs = stored(refs.withColumn("target_turn", _turn_of("target_place")), "calls-refs")
    lost = (refs.where("target_turn IS NULL OR target_turn > turn")
            .groupBy("conv_id", "place").agg(F.array_sort(F.collect_set(
                F.concat(F.lit("reference "), "target"))).alias("lost")))
    level = levels(refs.where("target_turn = turn")
                   .select("conv_id", "place", "target_place").distinct())
    joined = (
        called.alias("k")
        .join(first_call.alias("c"), _on("k", "c", "conv_id", "call_id"), "left")
        .join(first_result.alias("r"), _on("k", "r", "conv_id", "call_id"), "left")
        .join(lost.alias("x"), _on("k", "x", "conv_id", "place"), "left")
        .join(level.withColumn("leveled", F.lit(True)).alias("l"),
              _on("k", "l", "conv_id", "place"), "left"))
    repeated = F.col("k.place") > F.col("c.first")

    def flag(when, what):
        return F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))

    problems = F.concat(
        flag(F.col("k.call_id").isNull(), "no id"),
        flag(F.coalesce(repeated, F.lit(False)), "repeated id"),
        flag(F.col("r.first").isNull() | F.coalesce(repeated, F.lit(False)), "no result"),
        argument_problems(F.col("k.name"), F.col("k.args"), schemas),
        F.coalesce("x.lost", F.array().cast("array<string>")),
        flag(F.coalesce("l.leveled", F.lit(False)) & F.col("l.level").isNull(), "cycle"))
    return joined.select(
        "k.conv_id", "k.turn", "k.at", "k.place", "k.call_id", "k.name", "k.args",
        F.coalesce("l.level", F.lit(0)).alias("level"), problems.alias("problems"))


def _turn_of(place: str) -> Column:
    return F.floor(F.col(place) / F.lit(PLACES)).cast("bigint")


def events(messages: DataFrame, schemas) -> DataFrame:
    """conv_id, turn, step, at, part, kind, call_id, problems, json."""
    none = F.array().cast("array<string>")
    said = messages.where("result_for IS NULL").select(
        "conv_id", F.col("turn").cast("bigint"), F.lit(0).alias("step"), F.lit(0).alias("at"),
        F.lit(0).alias("part"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), none.alias("problems"),
        F.to_json(F.struct(F.lit("message").alias("kind"), "role", "text", "turn"), WHOLE)
        .alias("json"))
    called = stored(linked(messages, schemas), "calls-linked")
    asked = called.select(
        "conv_id", "turn", (F.col("level") + 1).alias("step"), "at", F.lit(0).alias("part"),
        F.lit("call").alias("kind"), "call_id", "problems",
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"),
                           F.lit("call").alias("kind"), "name", "problems", "turn"), WHOLE)
        .alias("json"))
    homes = (called.where("call_id IS NOT NULL AND NOT array_contains(problems, 'repeated id')")
             .groupBy("conv_id", "call_id").agg(
                 F.min("place").alias("place"), F.min("level").alias("level")))
    answered = results(messages)
    first = firsts(answered, "turn")
    found = (answered.alias("r").join(homes.alias("h"), _on("r", "h", "conv_id", "call_id"), "left")
             .join(first.alias("f"), _on("r", "f", "conv_id", "call_id"), "left")
             .select("r.*", "h.place", "h.level", F.col("f.first").alias("first"))
             .withColumn("call_turn", _turn_of("place"))
             .withColumn("early", F.coalesce(F.col("turn") <= F.col("call_turn"), F.lit(False)))
             .withColumn("problems", F.when(F.col("place").isNull(), F.array(F.lit("no call")))
                         .when(F.col("turn") > F.col("first"),
                               F.array(F.lit("repeated result"))).otherwise(none)))
    given = found.select(
        "conv_id", F.when(F.col("early"), F.col("call_turn")).otherwise(F.col("turn"))
        .alias("turn"),
        F.when(F.col("early"), F.col("level") + 1).otherwise(0).alias("step"),
        F.when(F.col("early"), F.col("place") % PLACES).otherwise(0).cast("int").alias("at"),
        F.when(F.col("early"), 1).otherwise(0).alias("part"), F.lit("result").alias("kind"),
        "call_id", "problems",
        F.to_json(F.struct(F.col("call_id").alias("id"), F.lit("result").alias("kind"),
                           "problems", F.col("text").alias("result"), "role", "turn"), WHOLE)
        .alias("json"))
    return said.unionByName(asked).unionByName(given)
