"""Loads are visible whole or not at all; ids are claimed; failed loads can be run again."""

import os
import tempfile
import threading

import pytest

from carelens import schema as S
from carelens.operators.star import build_star
from carelens.plans.append import append_star
from carelens.plans.load import numbered_visits
from carelens.sources.commits import LoadLog
from carelens.sources.fixtures import ORDER_KEY, halves, raw_visits
from carelens.sources.tables import TABLES, load_star, remove_unseen, save_star, write_part, write_table


@pytest.fixture(scope="module")
def parts(spark, sf001):
    """Two extracts' numbered visits, cut down, stored once."""
    base = tempfile.mkdtemp(prefix="carelens-parts-")
    out = []
    for i, raw in enumerate(halves(raw_visits(spark, sf001))):
        numbered_visits(raw.filter("measure_id LIKE 'READM_30_HF%' OR footnote != ''"), ORDER_KEY).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def content(star):
    return {n: sorted(map(tuple, df.collect()), key=repr) for n, df in star.tables().items()}


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="carelens-log-"), "star")


def dies_at(table):
    def write(name, df, path, part):
        if name == table:
            raise RuntimeError("dies here")
        return write_table(name, df, path, part)
    return write


def test_a_load_that_dies_changes_nothing(spark, parts):
    whole, broken = folder(), folder()
    for path in (whole, broken):
        append_star(spark, path, lambda start: parts[0], "one")
    append_star(spark, whole, lambda start: parts[1], "two")
    before = content(load_star(spark, broken))
    for table in TABLES:
        with pytest.raises(RuntimeError, match="dies here"):
            append_star(spark, broken, lambda start: parts[1], "two", write=dies_at(table))
        assert content(load_star(spark, broken)) == before
    append_star(spark, broken, lambda start: parts[1], "two")
    assert content(load_star(spark, broken)) == content(load_star(spark, whole))
    assert len(remove_unseen(spark, broken)) > 0 and remove_unseen(spark, broken) == []
    assert content(load_star(spark, broken)) == content(load_star(spark, whole))


def test_a_first_load_that_dies_leaves_no_star(spark, parts):
    path = folder()
    with pytest.raises(RuntimeError):
        append_star(spark, path, lambda start: parts[0], "one", write=dies_at("measures"))
    append_star(spark, path, lambda start: parts[0], "one")
    star = load_star(spark, path)
    assert star.performance_data.count() == parts[0].count() == star.performance_data.agg({"performance_id": "max"}).first()[0]


def test_a_replacing_load_that_dies_keeps_the_old_star(spark, parts):
    path = folder()
    save_star(build_star(parts[0]), path)
    before = content(load_star(spark, path))
    with pytest.raises(RuntimeError):
        save_star(build_star(parts[1]), path, write=dies_at("performance_data"))
    assert content(load_star(spark, path)) == before
    save_star(build_star(parts[1]), path)
    assert load_star(spark, path).performance_data.count() == parts[1].count()
    # the next load counts on from the new star's ids
    append_star(spark, path, lambda start: parts[0], "more")
    ids = [r[0] for r in load_star(spark, path).performance_data.select("performance_id").collect()]
    assert sorted(ids) == list(range(1, parts[0].count() + parts[1].count() + 1))


def test_two_loads_at_once(spark, parts):
    """Both see the star without the other; ids are disjoint and no facility is stored twice."""
    path, both = folder(), threading.Barrier(2, timeout=120)
    append_star(spark, path, lambda start: parts[0].limit(20), "start")
    waited, failed = set(), []

    def write(name, df, table_path, part):
        if name == "hospitals" and threading.current_thread().name not in waited and part.split("-")[0] not in waited:
            waited.add(part.split("-")[0])
            both.wait()
        return write_table(name, df, table_path, part)

    def load(k):
        try:
            append_star(spark, path, lambda start: parts[1], k, write=write)
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=load, args=(k,)) for k in ("left", "right")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    star = load_star(spark, path)
    n = 20 + 2 * parts[1].count()
    assert star.performance_data.count() == star.performance_data.select("performance_id").distinct().count() == n
    for table, key in (("hospitals", "facility_id"), ("measures", "measure_id"), ("footnotes", "footnote_id")):
        df = getattr(star, table)
        assert df.count() == df.select(key).distinct().count(), table
    assert star.performance_footnotes.join(star.performance_data, "performance_id", "left_anti").isEmpty()


def test_the_same_load_again_replaces_its_rows(spark, parts):
    path = folder()
    for _ in range(2):
        append_star(spark, path, lambda start: parts[0], "one")
        append_star(spark, path, lambda start: parts[1], "two")
    once = folder()
    append_star(spark, once, lambda start: parts[0], "one")
    append_star(spark, once, lambda start: parts[1], "two")
    a, b = content(load_star(spark, path)), content(load_star(spark, once))
    assert a["performance_data"] == b["performance_data"] and a["performance_footnotes"] == b["performance_footnotes"]
    assert sorted(r[0] for r in a["hospitals"]) == sorted(r[0] for r in b["hospitals"])


def test_a_star_without_a_log_is_taken_over(spark, parts):
    path = folder()
    write_part(build_star(parts[0]), path, "first")
    assert load_star(spark, path).performance_data.count() == parts[0].count()
    append_star(spark, path, lambda start: parts[1], "two")
    star = load_star(spark, path)
    assert star.performance_data.count() == parts[0].count() + parts[1].count()
    assert star.performance_data.select("performance_id").distinct().count() == star.performance_data.count()


def test_claims_are_disjoint(spark):
    path, got = folder(), []

    def claim(k):
        for i in range(5):
            got.append((LoadLog(spark, path).claim(f"{k}-{i}", 10), 10))

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(s for s, _ in got) == [10 * i for i in range(20)]
    assert LoadLog(spark, path).claim("0-0", 10) in {s for s, _ in got}


def test_an_empty_extract_adds_nothing(spark, parts):
    path = folder()
    append_star(spark, path, lambda start: parts[0], "one")
    counts = append_star(spark, path, lambda start: parts[1].filter("false"), "none")
    assert set(counts.values()) == {0}
    assert load_star(spark, path).performance_data.count() == parts[0].count()
    assert S.ROW_ID in parts[0].columns


def test_facts_numbered_by_facility_are_not_shuffled_to_be_stored(spark, sf001, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from carelens.plans.load import fixture_star
    star = fixture_star(spark, sf001)
    assert star.by_facility and not star.replace(performance_data=star.performance_data).by_facility
    ranged, kind = [], type(star.performance_data)
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda *a, **k: ranged.append(a) or plain(*a, **k))
    for name, given in (("by_facility", star), ("shuffled", star.replace(performance_data=star.performance_data))):
        ranged.clear()
        save_star(given, f"{tmp_path}/{name}")
        assert len(ranged) == (0 if given.by_facility else 1)
    here, there = (load_star(spark, f"{tmp_path}/{n}").performance_data for n in ("by_facility", "shuffled"))
    assert here.exceptAll(there).isEmpty() and there.exceptAll(here).isEmpty()
    files = spark.read.parquet(f"{tmp_path}/by_facility/performance_data").groupBy(F.input_file_name().alias("file"), "measure_family").agg(
        F.min("facility_id").alias("least"), F.max("facility_id").alias("greatest"))
    up_to = {}
    for r in sorted(files.collect(), key=lambda r: (r["measure_family"], r["least"], r["greatest"])):
        assert up_to.get(r["measure_family"], "") <= r["least"]
        up_to[r["measure_family"]] = r["greatest"]
