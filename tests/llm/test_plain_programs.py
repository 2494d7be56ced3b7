"""Tool call linking and quality scores against plain programs, over whole sample tables."""

import json
import math

import zstandard
from pyspark.sql import functions as F

from conftest import DATA
from logloom.llm import quality, queries, tool_calls

FOLDER = f"{DATA}/sf0.001"
KINDS = {"string": lambda x: isinstance(x, str),
         "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
         "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
         "boolean": lambda x: isinstance(x, bool)}


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def argument_problems(name, args):
    declared = {p: (kind, required) for tool, p, kind, required in queries.TOOLS if tool == name}
    if not declared:
        return ["unknown tool"]
    if not isinstance(args, dict):
        return ["no object"]
    return ([f"missing {p}" for p, (_, required) in declared.items() if required and p not in args]
            + [f"extra {p}" for p in sorted(set(args) - set(declared))]
            + [f"type {p}" for p, (kind, _) in declared.items()
               if p in args and not KINDS[kind](args[p])])


def conversation(messages):
    """Events of one conversation, whose messages are in order of turn."""
    calls, results = [], []
    for m in messages:
        for at, c in enumerate(m["calls"] or []):
            calls.append({"turn": m["turn"], "at": at, "id": c["id"], "name": c["name"],
                          "args": parsed(c["arguments"])})
        if m["result_for"] is not None:
            results.append(m)
    first = {}
    for c in calls:
        first.setdefault(c["id"], c)
    first_result = {}
    for r in results:
        first_result.setdefault(r["result_for"], r["turn"])
    for c in calls:
        values = c["args"].values() if isinstance(c["args"], dict) else []
        targets = {v[1:] for v in values if isinstance(v, str) and v.startswith("$")}
        c["lost"] = sorted(f"reference {t}" for t in targets
                           if t not in first or first[t]["turn"] > c["turn"])
        c["needs"] = [first[t] for t in targets if t in first and first[t]["turn"] == c["turn"]]
        c["level"] = 0 if not c["needs"] else None
    changed = True
    while changed:
        changed = False
        for c in calls:
            if c["level"] is None and all(n["level"] is not None for n in c["needs"]):
                c["level"], changed = 1 + max(n["level"] for n in c["needs"]), True
    out = []
    for m in messages:
        if m["result_for"] is None:
            out.append((m["turn"], 0, 0, 0, "message", None, [], {
                "kind": "message", "role": m["role"], "text": m["text"], "turn": m["turn"]}))
    for c in calls:
        repeated = first[c["id"]] is not c
        c["problems"] = ((["repeated id"] if repeated else [])
                         + (["no result"] if repeated or c["id"] not in first_result else [])
                         + argument_problems(c["name"], c["args"]) + c["lost"]
                         + (["cycle"] if c["level"] is None else []))
        out.append((c["turn"], (c["level"] or 0) + 1, c["at"], 0, "call", c["id"], c["problems"], {
            "arguments": c["args"], "id": c["id"], "kind": "call", "name": c["name"],
            "problems": c["problems"], "turn": c["turn"]}))
    for r in results:
        home = first.get(r["result_for"])
        problems = (["no call"] if home is None else
                    ["repeated result"] if r["turn"] > first_result[r["result_for"]] else [])
        early = home is not None and r["turn"] <= home["turn"]
        place = ((home["turn"], (home["level"] or 0) + 1, home["at"], 1) if early
                 else (r["turn"], 0, 0, 0))
        out.append((*place, "result", r["result_for"], problems, {
            "id": r["result_for"], "kind": "result", "problems": problems, "result": r["text"],
            "role": r["role"], "turn": r["turn"]}))
    return out


def test_tool_calls_of_all_conversations(spark):
    rows = queries.tool_messages(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    by_conversation = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        by_conversation.setdefault(r.conv_id, []).append(r.asDict(recursive=True))
    want = [(conv, *event) for conv, messages in by_conversation.items()
            for event in conversation(messages)]
    got = []
    for r in tool_calls.events(rows, queries.TOOLS).collect():
        found = json.loads(r.json)
        assert list(found) == sorted(found) and "\n" not in r.json
        got.append((r.conv_id, r.turn, r.step, r.at, r.part, r.kind, r.call_id, list(r.problems),
                    found))
    assert len({tuple(p) for *_, p, _ in got}) > 5  # many kinds of faults
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_score(text, model):
    data = (text or "").encode()
    cut = [data[i:i + model.block_bytes] for i in range(0, len(data), model.block_bytes)] or [b""]

    def size(dictionary):
        one = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False,
            write_dict_id=False)
        return sum(len(one.compress(b)) for b in cut)

    good, bad, length = size(model.good), size(model.bad), len(data) + 1
    inputs = [1, (bad - good) / (length + 64), (bad - good) / (good + bad), good / (length + 64),
              math.log(length)]
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, inputs, strict=True))))


def test_scores_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).select(
        "text", quality.score(F.col("text"), model).alias("score")).collect()
    for r in rows:
        assert abs(r.score - plain_score(r.text, model)) < 1e-9
