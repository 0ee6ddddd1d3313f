"""One facility's facts are read from a small part of the stored fact."""

import pytest
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.joins import scan_filter
from carelens.operators.star import Star
from carelens.plans import metrics as M
from carelens.session import scratch_path
from carelens.sources.tables import load_star, save_star

FACILITIES, FACTS = 400, 60_000


def facts(spark):
    """Half of the facts belong to one facility, the others to all in turn."""
    n = F.col("id")
    facility = F.when(n % 2 == 0, F.lit("F0007")).otherwise(F.format_string("F%04d", (n * 7919 % FACILITIES).cast("int")))
    given = {"performance_id": n, "facility_id": facility, "score": (n % 31).cast("double"),
             "measure_id": F.when(n % 3 == 0, "READM_1").when(n % 3 == 1, "EDAC_1").otherwise("HYBRID_1")}
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], S.STAR_DDL["performance_data"]).schema}
    return spark.range(1, FACTS + 1).select(
        *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def table(spark, name, **columns):
    kinds = spark.createDataFrame([], S.STAR_DDL[name]).schema
    rows = list(zip(*columns.values()))
    made = spark.createDataFrame(rows, list(columns)) if rows else spark.createDataFrame([], S.STAR_DDL[name])
    return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


@pytest.fixture(scope="module")
def stars(spark):
    ids = [f"F{i:04d}" for i in range(FACILITIES)]
    # six facilities share a name, all others have one of their own; one has no name
    names = ["shared" if i in (3, 90, 200, 201, 300, 390) else None if i == 11 else f"name {i}" for i in range(FACILITIES)]
    plain = Star(
        hospitals=table(spark, "hospitals", facility_id=ids, facility_name=names),
        measures=table(spark, "measures", measure_id=["READM_1", "EDAC_1", "HYBRID_1"], measure_name=["r", "e", "h"]),
        footnotes=table(spark, "footnotes"), performance_data=facts(spark),
        performance_footnotes=table(spark, "performance_footnotes"))
    path = scratch_path(spark, "clustered_star")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    hadoop.set("parquet.page.row.count.limit", "500")
    try:
        counts = save_star(plain, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        hadoop.unset("parquet.page.row.count.limit")
    assert counts["performance_data"] == FACTS  # counted once, though the ranges are sampled first
    return plain, load_star(spark, path), path


def rows_scanned(df):
    """Rows that the scans of the fact hand on, from the executed plan."""
    found = []

    def walk(p):
        kind = p.getClass().getName()
        if "AdaptiveSparkPlan" in kind:
            return walk(p.executedPlan())
        if "QueryStage" in kind:
            return walk(p.plan())
        if "FileSourceScan" in kind and "measure_family" in p.output().toString():
            found.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)  # none if an empty side ends the join early


def test_files_lie_by_facility(spark, stars):
    rows = (spark.read.parquet(f"{stars[2]}/performance_data")
            .groupBy(F.input_file_name().alias("file"), "measure_family")
            .agg(F.min("facility_id").alias("least"), F.max("facility_id").alias("greatest"), F.count("*").alias("n")).collect())
    assert len(rows) > 6
    # a facility with half of the facts is spread, and ranges of files meet at their ends at most
    assert max(r["n"] for r in rows) < FACTS / 4
    by_family = {}
    for r in sorted(rows, key=lambda r: (r["measure_family"], r["least"], r["greatest"])):
        assert by_family.get(r["measure_family"], "") <= r["least"]
        by_family[r["measure_family"]] = r["greatest"]


@pytest.mark.parametrize("name", ["name 5", "name 7", "shared", "nobody"])
def test_profile_equals_the_plain_join(stars, name):
    plain, stored, _ = stars
    named = plain.hospitals.filter(F.col("facility_name") == name).select("facility_id")
    want = (plain.performance_data.join(named, "facility_id").join(plain.measures.select("measure_id", "measure_name"), "measure_id")
            .groupBy("measure_name", "score").count().collect())
    for star in (plain, stored):
        got = M.hospital_profile(star, name).groupBy("measure_name", "score").count().collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert bool(want) == (name != "nobody")


def test_profile_reads_a_small_part(stars):
    stored = stars[1]
    assert 0 < rows_scanned(M.hospital_profile(stored, "name 5")) < FACTS / 8
    assert rows_scanned(M.hospital_profile(stored, "nobody")) == 0


def test_ids_reach_the_scan(stars):
    from tests.plan_report import plan_text
    text = plan_text(M.hospital_profile(stars[1], "name 5"))
    assert "EqualTo(facility_id,ScalarSubquery" in text


@pytest.mark.parametrize("keys", [[], [None], ["F0003"], ["F0003", None, "F0003"], [f"F{i:04d}" for i in range(0, 400, 30)]])
def test_filter_keeps_every_key(spark, keys):
    ids = spark.createDataFrame([(k,) for k in keys], "facility_id string")
    here = spark.range(FACILITIES).select(F.format_string("F%04d", F.col("id").cast("int")).alias("facility_id"))
    kept = {r[0] for r in here.filter(scan_filter("facility_id", ids)).collect()}
    wanted = {k for k in keys if k}
    assert wanted <= kept
    if len(wanted) <= 4:
        assert kept == wanted
