"""Report semantics on a hand-written star (FIXTURES.md section 4)."""

import datetime as dt

import pytest

from carelens.operators.star import Star
from carelens.plans import metrics as M
from carelens.plans.dashboard import dashboard

H = "facility_id string, facility_name string, address string, city_town string, state string, " \
    "zip_code string, county_parish string, telephone_number string"
P = "performance_id long, facility_id string, measure_id string, denominator double, score double, " \
    "lower_estimate double, higher_estimate double, number_of_patients int, " \
    "number_of_patients_returned int, performance_category string, start_date date, end_date date"

D = dt.date(2021, 7, 1)


def fact(pid, fac, mid, den, score, cat):
    den = None if den is None else float(den)
    return (pid, fac, mid, den, score, None, None, None, None, cat, D, D)


@pytest.fixture(scope="module")
def star(spark):
    hosp = [(f"F{i}", f"H{i}", "a", f"C{i}", "AA" if i < 4 else "BB", "00001", "c", "t")
            for i in range(7)]
    meas = [("READM_1", "Readm one"), ("EDAC_1", "Edac one"), ("OP_1", "Other"),
            ("READM_30_HF", "Heart failure")]
    facts = [
        fact(1, "F0", "READM_30_HF", 50, 9.0, "Average"),
        fact(2, "F1", "READM_30_HF", 150, 9.0, "Better than National Average"),
        fact(3, "F2", "READM_30_HF", 600, 9.0, "Worse than National Average"),
        fact(4, "F3", "READM_30_HF", 1200, 9.0, "Average"),
        fact(5, "F4", "READM_30_HF", 100, 9.0, "Average"),
        fact(6, "F5", "READM_30_HF", 100, 9.0, None),        # tie at rank 5: name decides
        fact(7, "F0", "READM_1", 100, -1.0, "Average"),
        fact(8, "F1", "EDAC_1", 500, 2.0, "Better than National Average"),
        fact(9, "F2", "OP_1", 1000, 50.0, "Average"),        # not a readmission measure
        fact(10, "F3", "READM_1", None, None, None),          # NULL score: dropped by REL
        fact(11, "ZZ", "READM_1", 700, 4.0, "Average"),      # unknown facility
    ]
    pf = [(1, 1), (2, 1), (3, 5), (4, None)]
    fn = [(1, None), (5, None)]
    return Star(
        hospitals=spark.createDataFrame(hosp, H),
        measures=spark.createDataFrame(meas, "measure_id string, measure_name string"),
        footnotes=spark.createDataFrame(fn, "footnote_id int, footnote_text string"),
        performance_data=spark.createDataFrame(facts, P),
        performance_footnotes=spark.createDataFrame(pf, "performance_id long, footnote_id int"),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_top_k_tie_is_broken_by_name(star):
    got = rows(M.worst_hospitals(star))
    assert len(got) == 5
    assert [r[0] for r in got] == ["H0", "H1", "H2", "H3", "H4"]


def test_empty_state_is_national(star):
    assert rows(M.worst_measures(star, "")) == rows(M.worst_measures(star))
    assert rows(M.kpis(star, "")) == rows(M.kpis(star))


def test_unknown_state(star):
    assert rows(M.kpis(star, "XX")) == [(0, None)]
    assert rows(M.worst_measures(star, "XX")) == []
    assert rows(M.national_breakdown(star, "XX")) == []


def test_base_stays_national(star):
    got = dict((r[0], (r[1], r[2])) for r in rows(M.national_breakdown(star, "BB")))
    # 9 facts have a category; BB holds F4 (Average) only among categorised facts
    assert got == {"Average": (1, 11.1)}


def test_national_shares(star):
    got = rows(M.national_breakdown(star))
    assert got[0] == ("Average", 6, 66.7)


def test_readmission_filter_and_joins(star):
    # SQL form joins measures only: the unknown facility's fact counts
    wm = dict((r[0], r[1:]) for r in rows(M.worst_measures(star)))
    assert wm["Readm one"] == (2, 1.5)
    assert "Other" not in wm
    # dashboard form joins hospitals too: it drops
    wj = dict((r[0], r[1:]) for r in rows(M.worst_measures(star, join_hospitals=True)))
    assert wj["Readm one"] == (1, -1.0)


def test_kpi_summary_vs_kpis(star):
    s = rows(M.kpi_summary(star))[0]
    k = rows(M.kpis(star))[0]
    assert s[0] == 7 and s[1] == 4
    assert s[2] != k[1]   # the unknown facility's score is only in the summary


def test_volume_tiers(star):
    got = dict((r[0], r[1:]) for r in rows(M.volume_tiers(star)))
    assert got["Small (<= 100 cases)"][0] == 4   # 50, 100, 100 and the READM_1 at 100
    short = dict(rows(M.volume_tiers_by_state(star, "AA")))
    assert set(short) == {"Small", "Medium", "Large", "Very Large"}


def test_state_threshold(star):
    assert rows(M.state_scores(star, 20)) == []
    got = rows(M.state_scores(star, 1))
    assert [r[0] for r in got] == ["AA", "BB"] or [r[0] for r in got] == ["BB", "AA"]
    assert {r[0] for r in rows(M.state_map(star, 2))} == {"AA"}


def test_common_footnotes_keeps_null_id(star):
    got = rows(M.common_footnotes(star))
    assert got[0] == (1, None, 2)
    assert (None, None, 1) in got


def test_profile_keeps_null_scores(star):
    got = rows(M.hospital_profile(star, "H3"))
    assert ("Readm one", None, None, None, None) in got
    assert len(got) == 2


def test_dashboard_matches_reports(star):
    d = dashboard(star, "AA")
    assert rows(d["worst_measures"]) == rows(M.worst_measures(star, "AA"))
    assert rows(d["performance_by_volume"]) == rows(M.volume_tiers_by_state(star, "AA"))
    full = dashboard(star)
    assert rows(full["state_details"]) == rows(M.state_details(star))
    assert sorted(rows(full["performance_by_state"])) == sorted(rows(M.state_map(star)))


def test_sql_on_registered_views(spark, star):
    from carelens.sources.tables import register_views
    register_views(star, prefix="v_")
    got = spark.sql("SELECT city_town, max(denominator) AS most FROM v_hospitals JOIN v_performance_data USING (facility_id) "
                    "GROUP BY city_town ORDER BY city_town")
    assert rows(got) == [("C0", 100.0), ("C1", 500.0), ("C2", 1000.0), ("C3", 1200.0), ("C4", 100.0), ("C5", 100.0)]


def test_averages_have_the_same_bits_whatever_the_partitions(spark, star):
    import random
    r = random.Random(1)
    facts = [fact(i, f"F{i % 7}", "READM_1", 10, round(r.uniform(-40, 40), 3), "Average") for i in range(3000)]
    want = None
    for n in (1, 3, 7, 37):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            s = star.replace(performance_data=spark.createDataFrame(facts, P).repartition(n))
            got = [rows(f(s)) for f in (M.kpis, M.worst_measures, lambda x: M.state_details(x, 0))]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        want = want or got
        assert repr(got) == repr(want)


@pytest.mark.parametrize("scores, mean", [([1.0, 1.01], 1.01), ([-1.0, -1.01], -1.01), ([0.005], 0.01), ([-0.004], 0.0),
                                          ([2.675], 2.68), ([1.0, 1.0, 2.0], 1.33), ([None], None)])
def test_averages_round_half_away_from_zero(spark, scores, mean):
    df = spark.createDataFrame([(x,) for x in scores], "score double")
    for plain in (False, True):
        assert df.select(M.overall_mean(df, "score", plain)).first()[0] == mean


def test_large_dimensions_are_shuffle_joined(spark, star):
    # without broadcasts the reports run as shuffle joins, with equal results
    from tests.plan_report import plan_text
    reports = {"details": M.state_details, "worst": lambda s: M.worst_measures(s, "AA"), "profile": lambda s: M.hospital_profile(s, "H3")}
    expected = {n: rows(f(star)) for n, f in reports.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = {n: rows(f(star)) for n, f in reports.items()}
        text = plan_text(M.state_details(star))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == expected
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def exact(values):
    """The mean of the numbers as they are written, rounded to cents, half away from zero."""
    import decimal
    known = [decimal.Decimal(repr(v)) for v in values if v is not None]
    with decimal.localcontext(prec=900):
        return float((sum(known) / len(known)).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)) if known else None


def test_means_of_any_doubles_are_exact(spark):
    import random
    r = random.Random(3)
    kinds = [lambda: float(r.randint(-50, 50)), lambda: r.randint(-9999, 9999) / 1000, lambda: r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300),
             lambda: 1e20, lambda: 1e-5, lambda: -1e20, lambda: r.choice([0.005, -0.005, 0.125, 2.675]), lambda: None, lambda: 5e-324, lambda: 1.7e308]
    values = {}
    for g in [None, *range(60)]:
        use = r.sample(kinds, r.randint(1, 4))
        values[g] = [r.choice(use)() for _ in range(r.randint(1, 40))]
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g int, x double")
    for parts in (1, 37):
        got = {a.g: a.m for a in M.grouped_mean(df.repartition(parts), ["g"], "x", "m").collect()}
        assert got == {g: exact(v) for g, v in values.items()}
    sets = M.grouped_mean(df, ["g"], "x", "m", sets=[[], ["g"]]).collect()
    assert {a.g: a.m for a in sets if not a.all_g} == got
    assert [a.m for a in sets if a.all_g] == [exact([x for v in values.values() for x in v])]


def test_a_star_said_to_be_plain_gives_no_wrong_mean(spark):
    import pytest as p
    df = spark.createDataFrame([(1e20,), (1.0,)], "score double")
    with p.raises(Exception, match="did not count"):
        df.select(M.overall_mean(df, "score", True)).collect()


def test_summary_of_wide_values(spark):
    from carelens.operators import quality as Q
    v = [1e20, -1e20, 1e-5, 3.0, None, 0.1]
    got = Q.metric_summary(spark.createDataFrame([(x,) for x in v], "score double"), ["score"]).first()
    assert (got.mean, got["min"], got["max"], got.median, got.missing) == ((3.10001) / 5, -1e20, 1e20, 0.1, 1)
