"""Plan properties that must hold at any scale (read from explain output)."""

import re

import pytest

import __spark_entry__ as E
from tests.plan_report import plan_text

READMISSION_REPORTS = ["worst_measures", "state_scores", "state_map", "state_details", "volume_tiers",
                       "volume_tiers_state", "kpi_summary", "kpis_state"]


@pytest.fixture(scope="module")
def plans(spark, sf001):
    return {n: plan_text(q(spark, sf001)) for n, q in E.core_queries().items()}


def test_no_python_and_no_pair_joins(plans):
    for name, text in plans.items():
        for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
            assert node not in text, (name, node)


@pytest.mark.parametrize("name", READMISSION_REPORTS)
def test_readmission_filter_reaches_the_scan(plans, name):
    text = plans[name]
    # beside the filter on the committed loads
    assert re.search(r"^PartitionFilters: \[.*\bmeasure_family#", text, re.M), name
    assert "StringStartsWith(measure_id,READM)" in text, name


def test_fact_scans_are_column_pruned(plans):
    # the volume report reads four fact columns, not all twelve
    text = plans["volume_tiers"]
    schema = [l for l in text.splitlines() if l.startswith("ReadSchema:")][0]
    assert "facility_id" not in schema and "start_date" not in schema


def test_reports_run_no_job_while_they_are_built(spark, sf001):
    from carelens.plans import load as L
    from carelens.plans import metrics as M
    from carelens.plans.dashboard import dashboard
    star = L.stored_fixture_star(spark, sf001)
    spark.sparkContext.setJobGroup("building", "reports")
    try:
        for f in (M.national_breakdown, M.worst_measures, M.worst_hospitals, M.state_scores, M.state_map, M.state_details,
                  M.common_footnotes, M.volume_tiers, M.volume_tiers_by_state, M.kpi_summary, M.kpis, dashboard):
            f(star)
        for f in (M.national_breakdown, M.worst_measures, M.worst_hospitals, M.volume_tiers_by_state, M.kpis, M.hospital_profile):
            f(star, "NATION_3")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_first_rows_are_found_by_hash_aggregation(plans):
    for name in ("hospitals", "measures"):
        assert "SortAggregate" not in plans[name], name


def test_quartiles_are_not_gathered_in_one_aggregate(plans):
    assert "percentile" not in plans["metric_summary"]


def test_file_order_needs_no_range_exchange(plans):
    assert "rangepartitioning" not in plans["csv_star_hospitals"]
