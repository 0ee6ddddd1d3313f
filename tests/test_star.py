"""Load invariants on the driver's smallest tables, and the row-id operator."""

import pytest
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.keys import dense_row_ids
from carelens.operators.star import footnote_ids, new_footnotes, performance_footnotes
from carelens.plans import load as L
from carelens.plans import metrics as M
from carelens.sources import fixtures as FX


@pytest.fixture(scope="module")
def star(spark, sf001):
    return L.fixture_star(spark, sf001)


def test_clean_keeps_every_row(spark, sf001):
    raw = FX.raw_visits(spark, sf001)
    assert L.fixture_visits(spark, sf001).count() == raw.count()


def test_ids_dense_and_unique(star):
    pd = star.performance_data
    n = pd.count()
    agg = pd.agg(F.min("performance_id"), F.max("performance_id"),
                 F.count_distinct("performance_id")).first()
    assert tuple(agg) == (1, n, n)


def test_ids_follow_the_row_order(star):
    rows = star.performance_data.orderBy("performance_id").select(
        "facility_id", "measure_id").collect()
    assert rows == sorted(rows, key=lambda r: (r[0], r[1]))


def test_dimension_keys_unique(star):
    for name, key in [("hospitals", "facility_id"), ("measures", "measure_id"),
                      ("footnotes", "footnote_id")]:
        df = getattr(star, name)
        assert df.count() == df.select(key).distinct().count()


def test_hospitals_take_first_row(spark, sf001, star):
    # each hospital's telephone comes from its row with the smallest id
    v = L.fixture_numbered_visits(spark, sf001)
    first = (v.groupBy("facility_id").agg(F.min(S.ROW_ID).alias(S.ROW_ID))
             .join(v, ["facility_id", S.ROW_ID]).select("facility_id", "telephone_number"))
    got = star.hospitals.select("facility_id", "telephone_number")
    assert first.count() == got.count()
    assert got.exceptAll(first).count() == 0


def test_junction_keys_exist_in_fact(star):
    orphans = star.performance_footnotes.join(star.performance_data, "performance_id", "left_anti")
    assert orphans.count() == 0


def test_rerun_of_footnotes_adds_nothing(star):
    assert new_footnotes(star.footnotes, star.footnotes).count() == 0


def test_footnote_split_orders_differ(spark):
    v = spark.createDataFrame([(1, "1, "), (2, "5"), (3, ""), (4, None), (5, "1,7")],
                              f"{S.ROW_ID} long, footnote string")
    ids = sorted(r[0] for r in footnote_ids(v).collect() if r[0] is not None)
    assert ids == [1, 5]
    assert None in [r[0] for r in footnote_ids(v).collect()]  # '1,7' is one token -> NULL id
    links = sorted(performance_footnotes(v).collect(), key=lambda r: (r[0], r[1] is None, r[1]))
    assert [tuple(r) for r in links] == [(1, 1), (1, None), (2, 5), (5, None)]


def test_null_safe_anti_join(spark):
    a = spark.createDataFrame([(None,), (1,), (7,)], "footnote_id int")
    b = spark.createDataFrame([(None,), (1,)], "footnote_id int")
    assert [r[0] for r in new_footnotes(a, b).collect()] == [7]


def test_national_counts_sum_to_categorised_rows(spark, sf001, star):
    v = L.fixture_visits(spark, sf001)
    total = v.filter(F.col("performance_category").isNotNull()).count()
    assert sum(r.number_of_measures for r in M.national_breakdown(star).collect()) == total


def test_state_kpis_sum_to_national(star):
    states = [r[0] for r in star.hospitals.select("state").distinct().collect()]
    national = M.kpis(star).first().total_hospitals
    assert sum(M.kpis(star, s).first().total_hospitals for s in states) == national


def test_dense_ids_split_identical_rows(spark):
    # one group of identical rows holds half of the input; the tie-break on
    # the source id spreads it over partitions and the ids stay dense
    rows = [("A", "x", i) for i in range(400)] + [(f"k{i:03d}", "y", 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, f"k string, v string, {S.SOURCE_ID} long")
    out = dense_row_ids(df, ["k", S.SOURCE_ID], num_partitions=8)
    got = out.agg(F.min("temp_id"), F.max("temp_id"), F.count_distinct("temp_id")).first()
    assert tuple(got) == (1, 800, 800)
    first_k = [r.k for r in out.orderBy("temp_id").limit(400).collect()]
    assert set(first_k) == {"A"}


def test_dense_ids_start_offset(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k int")
    out = dense_row_ids(df, ["k"], start=100)
    assert [r.temp_id for r in out.orderBy("k").collect()] == list(range(101, 151))


def test_first_row_with_a_hot_facility(spark):
    # one facility holds a third of the rows; its first row still wins
    from carelens.operators.dedup import first_row_per_key
    rows = [("HOT", f"t{i:04d}", i) for i in range(300, 0, -1)]
    rows += [(f"F{i:03d}", f"u{i}", 1000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "facility_id string, telephone_number string, temp_id long")
    out = dict(first_row_per_key(df.repartition(8), "facility_id",
                                 ["facility_id", "telephone_number"], "temp_id").collect())
    assert out["HOT"] == "t0001"
    assert len(out) == 601


def test_breakdown_check_agrees_with_national_breakdown(spark, sf001, star):
    from carelens.operators.quality import breakdown_check
    n1 = {r[0]: (r[1], r[2]) for r in M.national_breakdown(star).collect()}
    c4 = {r.performance_category: (r.number_of_measures, r.percentage)
          for r in breakdown_check(star.performance_data).collect()}
    assert set(n1) == set(c4)
    for k in n1:
        assert n1[k][0] == c4[k][0]
        assert abs(n1[k][1] - c4[k][1]) <= 0.1 + 1e-9


def test_metric_summary_exact(spark):
    from carelens.operators.quality import metric_summary
    vals = [(float(i), float(i % 7), i % 5) for i in range(1, 1001)] + [(None, None, None)]
    df = spark.createDataFrame(vals, "score double, denominator double, number_of_patients int")
    exact = {r.variable: r for r in metric_summary(df).collect()}
    s = exact["score"]
    assert (s.min, s.q1, s.median, s.q3, s.max, s.missing) == (1.0, 250.75, 500.5, 750.25, 1000.0, 1)
    assert exact["number_of_patients"].missing == 1


def test_quartiles_equal_sorted_values(spark):
    import random
    import statistics
    from carelens.operators.quality import metric_summary
    r = random.Random(2)
    a = [round(r.gauss(0, 50), 2) for _ in range(777)] + [5.0] * 300
    b = [r.choice([0.0, 1e9, -1e9, 0.25]) for _ in a]
    df = spark.createDataFrame([(x, y, 3) for x, y in zip(a, b)], "score double, denominator double, number_of_patients int")
    got = {x.variable: x for x in metric_summary(df.repartition(7)).collect()}
    for name, v in (("score", a), ("denominator", b)):
        want = statistics.quantiles(v, n=4, method="inclusive")
        assert [got[name].q1, got[name].median, got[name].q3] == pytest.approx(want, abs=1e-9)
    assert got["number_of_patients"].q1 == got["number_of_patients"].q3 == 3.0


def test_dense_ids_balance_a_hot_group(spark):
    # half of the rows share one order key; the written partitions stay balanced
    import tempfile
    rows = [("HOT", i) for i in range(4000)] + [(f"k{i:05d}", 10_000 + i) for i in range(4000)]
    df = spark.createDataFrame(rows, f"k string, {S.SOURCE_ID} long")
    path = tempfile.mkdtemp(prefix="carelens-ids-") + "/t"
    dense_row_ids(df, ["k", S.SOURCE_ID], num_partitions=8, path=path)
    sizes = [r[1] for r in spark.read.parquet(path).groupBy("_pid").count().collect()]
    assert sum(sizes) == 8000
    assert max(sizes) <= 0.3 * 8000
