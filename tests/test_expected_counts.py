"""Figures of the sample inputs that were worked out apart from this code."""

from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logloom.plans.queries import QUERIES, Tables
from logloom.operators import payload, turns
from logloom.plans import inputs


@pytest.fixture(scope="module")
def run(spark):
    tables = Tables(spark, f"{DATA}/sf0.01")
    return lambda name: [row.asDict() for row in QUERIES[name](tables).collect()]


def test_log_roles(run):
    counts = {r["role"]: r["n"] for r in run("log_role_counts")}
    assert counts == {"user": 9816, "assistant": 9816, "tool_log": 8018,
                      "evaluator_log": 1010, "guardrail_log": 184}


def test_kpis(run):
    assert run("dashboard_kpis") == [{
        "sessions": 3984, "lead_rate": 29.5, "lead_sessions": 1176, "call_sessions": 1604,
        "unknown_rate": 34.7}]


def test_top_questions_keep_first_seen_order_on_ties(run):
    assert [(r["question"], r["times"]) for r in run("top_unknown_questions")] == [
        ("q34", 60), ("q8", 57), ("q35", 56), ("q15", 54), ("q17", 53), ("q28", 52),
        ("q18", 52), ("q0", 51)]


def test_ratings(run):
    assert [(r["rating"], r["count"]) for r in run("rating_histogram")] == [
        ("1", 335), ("2", 163), ("3", 188), ("4", 177), ("5", 200)]


def test_days(run):
    days = run("daily_activity")
    assert len(days) == 28
    assert [d["value"] for d in days[:2]] == [324, 134]
    assert [d["value"] for d in days[-2:]] == [322, 133]
    assert (days[0]["day"], days[-1]["day"]) == ("2024-01-17", "2024-01-30")


def test_failures_and_blocks(run):
    assert run("failure_count") == [{"failures": 497}]
    assert Counter(r["reason"] for r in run("guard_blocks")) == {"rate_limit": 104, "unsafe": 80}


def test_cascade(run):
    assert len(run("unsafe_messages")) == 42
    assert sum(r["operational"] for r in run("operational_turns")) == 46
    graded = run("quality_cascade")
    assert Counter(r["outcome"] for r in graded) == {
        "length": 153, "operational_length": 11, "age": 5, "missing_tool": 3, "to_judge": 61}
    assert sum(r["words"] > 100 for r in graded) == 164


def test_draft_outcomes(spark):
    rows = turns.turn_outcomes(inputs.drafts(spark.read.parquet(
        f"{DATA}/sf0.01/events.parquet")))
    found = {tuple(r)[:3]: r["n"] for r in rows.groupBy(
        "attempts", "passed", "max_retries_exceeded").agg(F.count("*").alias("n")).collect()}
    assert found == {
        (0, True, False): 2000, (1, True, False): 1667, (2, True, False): 1333,
        (3, True, False): 1000, (0, False, False): 1333, (1, False, False): 999,
        (2, False, False): 667, (3, False, True): 1001}
    assert rows.agg(F.max(F.size("rejections"))).first()[0] == 4


def test_rate_limit(run):
    rejected = [r["id"] for r in run("rate_limit_decisions") if not r["within_limit"]]
    assert (len(rejected), sum(rejected)) == (2433, 12232432)


def test_checklist(run):
    items = run("checklist_items")
    assert (len(items), sum(i["done"] for i in items)) == (4034, 216)
    assert len(run("checklist_bad_marks")) == 1783


def test_entries(spark):
    tables = Tables(spark, f"{DATA}/sf0.01")
    assert payload.tool_entries(tables.log).count() == 9665
