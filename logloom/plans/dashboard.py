"""The dashboard as one bundle of DataFrames."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from logloom.operators import metrics, mining
from logloom.operators.payload import evaluator_entries, tool_entries


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    daily: DataFrame
    unknown: DataFrame
    ratings: DataFrame
    failures: DataFrame


def load_dashboard(messages: DataFrame) -> Dashboard:
    """All dashboard tables; nothing runs until one of them is read.

    Each reads only the roles and columns it needs. Where several are read,
    pass a written or cached log to share the scan.
    """
    entries = tool_entries(messages)
    return Dashboard(
        kpis=metrics.dashboard_kpis(messages),
        daily=metrics.daily_activity(messages),
        unknown=metrics.top_unknown_questions(entries),
        ratings=metrics.rating_histogram(entries),
        failures=mining.failure_count(mining.max_retry_failures(evaluator_entries(messages))),
    )
