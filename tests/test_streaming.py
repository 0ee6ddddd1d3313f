"""Incremental load: extracts streamed into one star."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.plans.append import append_star
from carelens.plans.load import numbered_visits
from carelens.sources.csv import read_raw_visits, write_csv
from carelens.sources.fixtures import EXTRACT_HEADER, halves, raw_visits
from carelens.sources.tables import TABLES, load_star
from carelens.streaming import load_batch, start_incremental_load
from carelens.streaming.ingest import source_key


def ids(star):
    return tuple(star.performance_data.agg(F.min("performance_id"), F.max("performance_id"),
                                           F.count_distinct("performance_id"), F.count("*")).first())


def write_extract(df, path):
    write_csv(df.coalesce(1).toDF(*EXTRACT_HEADER), path)


def run(spark, landing, star_path):
    start_incremental_load(spark, landing + "/*", star_path).awaitTermination(300)
    return load_star(spark, star_path)


def test_extracts_of_two_folders_stream_into_one_star(spark, sf001):
    raw = raw_visits(spark, sf001).select(*S.RAW_COLUMNS)
    early, late = halves(raw)
    base = tempfile.mkdtemp(prefix="carelens-stream-")
    one, two, star_path = (os.path.join(base, x) for x in ("one", "two", "star"))

    write_extract(early, os.path.join(one, "a"))
    first = run(spark, one, star_path)
    n1 = early.count()
    assert ids(first) == (1, n1, n1, n1)
    kept = {r.facility_id: r for r in first.hospitals.collect()}

    # nothing new in the folder: nothing happens
    assert ids(run(spark, one, star_path)) == (1, n1, n1, n1)

    # another landing folder, with default arguments, adds and takes nothing away
    write_extract(late, os.path.join(two, "b"))
    star = run(spark, two, star_path)
    n = raw.count()
    assert ids(star) == (1, n, n, n)
    h = {r.facility_id: r for r in star.hospitals.collect()}
    assert star.hospitals.count() == len(h) == raw.select("facility_id").distinct().count()
    assert all(h[k] == v for k, v in kept.items())
    assert star.measures.count() == raw.select("measure_id").distinct().count()
    assert sorted(r[0] for r in star.footnotes.collect()) == [1, 5, 7]
    assert star.performance_footnotes.join(star.performance_data, "performance_id", "left_anti").count() == 0

    # a batch that is run again replaces its own rows
    counts = load_batch(spark, [os.path.join(two, "b")], star_path, f"{source_key(two + '/*')}-0")
    assert counts["performance_data"] == late.count() and counts["footnotes"] == 0
    again = load_star(spark, star_path)
    assert ids(again) == (1, n, n, n) and again.hospitals.count() == len(h)


def test_append_numbers_go_on_and_dimensions_stay_unique(spark, sf001):
    base = tempfile.mkdtemp(prefix="carelens-append-")
    raw = raw_visits(spark, sf001).select(*S.RAW_COLUMNS)
    write_extract(raw.limit(51), os.path.join(base, "x"))
    got = read_raw_visits(spark, os.path.join(base, "x"))
    for k in (1, 2):
        counts = append_star(spark, os.path.join(base, "star"), lambda start: numbered_visits(got, [], start=start))
        assert counts["performance_data"] == 51 and (counts["hospitals"] > 0) == (k == 1)
        star = load_star(spark, os.path.join(base, "star"))
        assert ids(star) == (1, 51 * k, 51 * k, 51 * k)
    assert star.hospitals.count() == star.hospitals.select("facility_id").distinct().count()


def test_half_a_star_is_an_error(spark, sf001):
    base = tempfile.mkdtemp(prefix="carelens-half-")
    os.makedirs(os.path.join(base, TABLES[0]))
    with pytest.raises(ValueError, match="not a star"):
        append_star(spark, base, lambda start: None)
