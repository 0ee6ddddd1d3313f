"""The load and reports when one facility holds half of the rows."""

import tempfile

from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.keys import dense_row_ids
from carelens.operators.clean import clean_visits
from carelens.operators.star import build_star
from carelens.plans import metrics as M
from carelens.sources.fixtures import ORDER_KEY, raw_visits


def test_hot_facility_end_to_end(spark, sf001):
    raw = raw_visits(spark, sf001)
    n = raw.count()
    hot = raw.filter(F.col("facility_id") == "000001")
    k = max(1, n // hot.count())
    # copies of the hot facility's rows, each with its own source id
    copies = (hot.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn(S.SOURCE_ID, F.col(S.SOURCE_ID) * 1000 + F.col("_copy").cast("long") + 10**12)
              .drop("_copy"))
    skewed = raw.unionByName(copies)
    total = skewed.count()
    hot_rows = skewed.filter(F.col("facility_id") == "000001").count()
    assert hot_rows * 3 >= total

    path = tempfile.mkdtemp(prefix="carelens-skew-") + "/ids"
    numbered = dense_row_ids(skewed, ORDER_KEY + [S.SOURCE_ID], id_col=S.ROW_ID,
                             num_partitions=8, path=path)
    sizes = [r[1] for r in spark.read.parquet(path).groupBy("_pid").count().collect()]
    assert sum(sizes) == total and max(sizes) <= 0.25 * total

    star = build_star(clean_visits(numbered))
    pd_ = star.performance_data
    assert tuple(pd_.agg(F.min("performance_id"), F.max("performance_id"),
                         F.count_distinct("performance_id")).first()) == (1, total, total)
    assert star.hospitals.count() == skewed.select("facility_id").distinct().count()

    # reports against a plain computation on the same rows
    facts = pd_.join(star.hospitals.select("facility_id", "state"), "facility_id").toPandas()
    rel = facts[facts.score.notna() & facts.measure_id.str.match(r"^(READM|EDAC)")]
    want = {s: (g.facility_id.nunique(), g.score.mean()) for s, g in rel.groupby("state")}
    got = {r.state: (r.number_of_hospitals, r.average_state_score)
           for r in M.state_scores(star, 0).collect()}
    assert set(got) == set(want)
    for s in want:
        assert got[s][0] == want[s][0]
        assert abs(got[s][1] - want[s][1]) <= 0.005 + 1e-9
