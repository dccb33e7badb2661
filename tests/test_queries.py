"""Registered queries: oracles on the smallest tables, plan shape and registration."""

import pytest

import __spark_entry__ as entry
from checks.registry import all_checks
from executions import Executions
from oracle import compare, duck

# One query per module and kind of plan; `python tests/oracle.py` runs all of them.
SAMPLE = (
    "client_stats", "dimension_stats", "ranking_grouping_sets", "temporal_trend_by_channel", "churn_summary", "enrich", "faceted_filters", "profile",
    "tasks", "summary", "interactive_cube", "consistency_checks", "sellers_dashboard", "cohorts", "pareto", "budget_dimension", "opportunities",
    "sensitivity", "mtd_clients", "daily_cumulative", "insights", "normalize_sales", "erp_lines", "article_groups", "route_dedupe", "compaction", "uncovered_ranges",
    "range_replace", "line_merge", "line_merge_by_id", "merge_outcome", "period_context", "load_windows", "batch_totals", "coverage_of_store", "source_fallback", "analysis_runs",
    "executive_fallback_sales", "executive_fallback_units", "mapping_validation", "excel_dates", "task_slots", "combos", "rankings", "direction_board",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, con, sf_dir, name):
    verdict = compare(entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df())
    assert not verdict or verdict.startswith("~"), verdict


@pytest.mark.parametrize("name", ("dimension_ranking_clients", "client_stats", "summary", "interactive_cube", "faceted_filters", "mtd_summary", "cohorts", "enrich", "kpis"))
def test_plans_stay_in_the_jvm_and_join_by_key(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan


REPORTS = ("insights", "direction_board", "report_triggers", "summary", "opportunities", "alerts", "clients_alerts", "role_alerts", "churn_summary", "board_kpis")


@pytest.mark.parametrize("name", REPORTS)
def test_reports_read_the_fact_once(spark, sf_dir, name):
    """Over all plans that the query runs, those while it is built included. What is kept is an aggregate, and nothing is left under another name."""
    seen = Executions(spark)
    entry.queries()[name](spark, sf_dir).collect()
    assert 1 <= seen.scans("lineitem") <= 3
    assert not seen.copies()


@pytest.mark.parametrize("name", ("client_stats", "dimension_stats", "consistency_totals"))
def test_distinct_counts_do_not_expand_the_fact(spark, sf_dir, name):
    assert "Expand" not in entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_date_filters_reach_the_scan(spark, sf_dir):
    plan = entry.queries()["coverage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_every_query_has_an_oracle_and_entry_runs(spark):
    assert {name for checks in all_checks() for name in checks.queries} <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
