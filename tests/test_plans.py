"""What the plans must not contain, and what must stay bounded."""

import re

import pytest
from conftest import DATA

from logloom.plans.queries import QUERIES, Tables

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
# the ordered pass of the rate limit is the only Python in batch queries
PYTHON = {"burst_rate_limit", "rate_limit_decisions", "guard_decisions", "guard_block_log", "outbox"}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_stray_python(tables, name):
    text = plan(QUERIES[name](tables))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert ("MapInPandas" in text) == (name in PYTHON)
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", BATCH)
def test_ordered_windows_never_hold_a_whole_session_of_log_rows(tables, name):
    """A window per session may run over block or cell summaries only."""
    text = plan(QUERIES[name](tables))
    for window in re.findall(r"windowspecdefinition\(([^)]*)\)", text):
        keys = window.split(" ASC")[0].split(" DESC")[0]
        if "session_id" in keys and "_block" not in keys and "_cell" not in keys:
            # a session's rows of one timestamp are those of its turns at that time
            assert "_chunk" in keys or "_at" in keys or "timestamp" in keys, window


def test_aggregations_by_session_hash(tables):
    for name in ["dashboard_kpis", "session_flags", "top_unknown_questions", "rating_histogram",
                 "checklist_items", "daily_activity", "log_role_counts"]:
        assert "SortAggregate" not in plan(QUERIES[name](tables)), name


def test_rate_limit_gathers_by_slice_and_reads_it_once(tables):
    rows = QUERIES["rate_limit_decisions"](tables)
    rows.collect()
    text = plan(rows)
    assert "WindowGroupLimit" in text
    for keys in re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", text):
        assert "_cell" in keys
    assert "ReusedExchange" in text.split("MapInPandas")[1]


def test_operational_signal_shuffles_no_texts(tables):
    text = plan(QUERIES["operational_turns"](tables))
    for line in text.split("\n"):
        if "Window" in line:
            assert "content" not in line
