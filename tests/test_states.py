"""Reports from stored partial results, all states at once, and the constraint report."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.clean import clean_visits
from carelens.operators.constraints import load_constraints, lost_values, rejected_facts
from carelens.operators.star import Star
from carelens.plans import load as L
from carelens.plans import metrics as M
from carelens.plans import states as ST
from carelens.plans.all_states import dashboard_all_states
from carelens.sources.tables import load_star, save_star
from tests.plan_report import plan_text


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def small_star(spark, facts, hospitals):
    return Star(
        hospitals=spark.createDataFrame([(f, f"H {f}", "a", "c", st, "z", "y", "t") for f, st in hospitals], S.STAR_DDL["hospitals"]),
        measures=spark.createDataFrame([("READM_30_HF", "heart"), ("EDAC_1", "days")], S.STAR_DDL["measures"]),
        footnotes=spark.createDataFrame([(1, None)], S.STAR_DDL["footnotes"]),
        performance_data=spark.createDataFrame(
            [(i, f, m, d, s, None, None, None, None, "Average", None, None) for i, f, m, d, s in facts], S.STAR_DDL["performance_data"]),
        performance_footnotes=spark.createDataFrame([(1, 1)], S.STAR_DDL["performance_footnotes"]))


@pytest.fixture(scope="module")
def loads(spark):
    """Two loads; the facility F3 has facts in the first and is known from the second on. One score is wide."""
    path = os.path.join(tempfile.mkdtemp(prefix="carelens-states-"), "star")
    one = [(1, "F1", "READM_30_HF", 10.0, 1.25), (2, "F1", "EDAC_1", 20.0, -3.5), (3, "F2", "READM_30_HF", None, 1e20),
           (4, "F3", "EDAC_1", 5.0, 7.0), (5, "F1", "OP_1", 1.0, 99.0), (6, None, "EDAC_1", 1.0, 4.0), (7, "F2", "EDAC_1", 3.0, None)]
    two = [(8, "F1", "EDAC_1", 2.0, 0.001), (9, "F2", "READM_30_HF", 4.0, -1e20), (10, "F2", "EDAC_1", 4.0, 1e-7), (11, "F3", "EDAC_1", 6.0, 2.0)]
    save_star(small_star(spark, one, [("F1", "AA"), ("F2", "BB")]), path, load_id="one")
    save_star(small_star(spark, two, [("F3", "AA")]), path, mode="append", load_id="two")
    return load_star(spark, path)


def test_merged_reports_equal_the_reports(loads):
    assert not loads.plain_scores
    assert rows(ST.state_details_merged(loads, 0)) == rows(M.state_details(loads, 0))
    assert rows(ST.state_scores_merged(loads, 1)) == rows(M.state_scores(loads, 1))
    assert rows(ST.state_map_merged(loads, 0)) == rows(M.state_map(loads, 0))
    for state in (None, "AA", "BB", "NOWHERE"):
        assert rows(ST.kpis_merged(loads, state)) == rows(M.kpis(loads, state))


def test_merged_reports_do_not_read_the_fact(loads):
    for df in (ST.state_details_merged(loads), ST.kpis_merged(loads)):
        assert "performance_data" not in plan_text(df)
    assert "performance_data" in plan_text(M.state_details(loads))


def test_another_fact_has_no_partial_results(loads):
    with pytest.raises(ValueError, match="without"):
        ST.state_details_merged(loads.replace(performance_data=loads.performance_data.limit(1)))


def test_all_states_equal_the_single_reports(spark, sf001):
    star = L.stored_fixture_star(spark, sf001)
    orphans = star.performance_data.limit(50).withColumn("facility_id", F.lit("nobody"))
    star = star.replace(performance_data=star.performance_data.unionByName(orphans))
    got = dashboard_all_states(star).collect()
    part = lambda scope, section: [r for r in got if (r.scope, r.section) == (scope, section)]
    states = [r[0] for r in star.hospitals.select("state").distinct().collect()]
    assert {r.scope for r in got} == {*states, "national"}
    for scope, state in [("national", None), *[(s, s) for s in sorted(states)[:4]]]:
        assert sorted((r["item"], r.number, r.value) for r in part(scope, "breakdown")) == rows(M.national_breakdown(star, state))
        assert sorted((r["item"], r.value) for r in part(scope, "volume_tiers")) == rows(M.volume_tiers_by_state(star, state))
        assert [(r.number, r.value) for r in part(scope, "kpis")] == rows(M.kpis(star, state))
        worst = M.worst_measures(star, state, join_hospitals=True).collect()
        assert [(r["item"], r.number, r.value) for r in sorted(part(scope, "worst_measures"), key=lambda r: r.rank)] == list(map(tuple, worst))
        top = [(" | ".join(r[:3]), r.score) for r in M.worst_hospitals(star, state).collect()]
        mine = [(r["item"], r.value) for r in sorted(part(scope, "worst_hospitals"), key=lambda r: r.rank)]
        assert [v for _, v in mine] == [v for _, v in top]
    assert "WindowGroupLimit" in plan_text(dashboard_all_states(star))


def test_all_states_with_wide_scores(loads):
    got = {(r.scope, r.section, r["item"]): r.value for r in dashboard_all_states(loads).collect()}
    assert got["BB", "kpis", None] == M.kpis(loads, "BB").first()[1]
    assert got["national", "worst_measures", "heart"] == M.worst_measures(loads, join_hospitals=True).filter("measure_name = 'heart'").first()[2]


def test_constraints(spark, loads):
    found = {(r.kind, r.table_name, r.column_name): r.violations for r in load_constraints(loads).collect()}
    assert found["foreign key", "performance_data", "measure_id"] == 1  # OP_1
    assert found["foreign key", "performance_data", "facility_id"] == 0
    # both loads of this star bring the same measures and links
    assert found["primary key", "measures", "measure_id"] == 2 and found["primary key", "performance_data", "performance_id"] == 0
    assert [(r.performance_id, r.reason) for r in rejected_facts(loads).collect()] == [(5, "unknown measure_id")]


def test_values_lost_in_conversion(spark):
    values = [("12", "07/01/2021"), ("12x", "2021-31-31"), ("Not Available", ""), (" ", None)]
    raw = spark.createDataFrame([(i, *[score if c == "score" else date if c == "start_date" else "" for c in S.RAW_COLUMNS])
                                 for i, (score, date) in enumerate(values)], "temp_id long, " + ", ".join(f"{c} string" for c in S.RAW_COLUMNS))
    found = {r.column_name: r.violations for r in lost_values(raw, clean_visits(raw)).collect()}
    assert found["score"] == 1 and found["start_date"] == 1 and found["denominator"] == 0
