"""Extracts of files with unlike headers; row numbers that do not depend on how a scan is cut."""

import gzip
import os
import tempfile

import pytest

from carelens import schema as S
from carelens.sources.csv import file_order_ids, header_manifest, read_raw_visits, with_file_place
from carelens.sources.fixtures import EXTRACT_HEADER


def row(**values):
    return {c: values.get(c, c[:3]) for c in S.RAW_COLUMNS}


def extract(folder, name, columns, rows, opener=open):
    """A CSV file with the given header names; a row gives its cells by normalised name."""
    by_header = dict(zip(EXTRACT_HEADER, S.RAW_COLUMNS))
    with opener(os.path.join(folder, name), "wt", encoding="utf-8") as f:
        f.write(",".join(f'"{c}"' for c in columns) + "\n")
        for r in rows:
            f.write(",".join('"{}"'.format(r[by_header[c]] if c in by_header else "extra") for c in columns) + "\n")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="carelens-mixed-")


def names(df):
    return [r.facility_name for r in df.orderBy(S.SOURCE_ID).collect()]


def test_each_file_is_read_by_its_own_header(spark, folder):
    rows = [row(facility_name=f"{k}{i}", facility_id=f"id{k}{i}", end_date="") for k in "abcde" for i in range(3)]
    extract(folder, "a.csv", EXTRACT_HEADER, rows[:3])
    extract(folder, "b.csv", EXTRACT_HEADER[::-1], rows[3:6])
    extract(folder, "c.csv", ["New, Column", *EXTRACT_HEADER[5:], *EXTRACT_HEADER[:5], "Facility ID "], rows[6:9])
    extract(folder, "d.csv.gz", EXTRACT_HEADER[::-1], rows[9:12], gzip.open)
    extract(folder, "e [1].csv", [c.upper() for c in EXTRACT_HEADER], [])
    open(os.path.join(folder, "f.csv"), "w").close()
    extract(folder, "g é.csv", EXTRACT_HEADER, rows[12:])
    got = read_raw_visits(spark, folder)
    assert [{c: r[c] for c in S.RAW_COLUMNS} for r in got.orderBy(S.SOURCE_ID).collect()] == rows
    assert sorted(r[0] for r in got.select(S.SOURCE_ID).collect()) == list(range(1, 16))
    groups = header_manifest(spark, folder)
    assert sorted(len(f) for f in groups.values()) == [1, 2, 3]
    assert names(read_raw_visits(spark, folder, multiline=False)) == [r["facility_name"] for r in rows]


def test_a_file_that_lacks_a_column_is_named(spark, folder):
    extract(folder, "a.csv", EXTRACT_HEADER, [row()])
    extract(folder, "b.csv", [c for c in EXTRACT_HEADER if c not in ("Score", "State")], [row()])
    with pytest.raises(ValueError, match=r"b\.csv lacks \['state', 'score'\]"):
        read_raw_visits(spark, folder)
    with pytest.raises(ValueError, match=r"b\.csv lacks \['score'\]"):
        read_raw_visits(spark, folder, optional=("state",))
    got = read_raw_visits(spark, folder, optional=("state", "score")).orderBy(S.SOURCE_ID).collect()
    assert [(r.state, r.score) for r in got] == [("sta", "sco"), ("", "")]


def test_no_files_with_rows(spark, folder):
    extract(folder, "a.csv", EXTRACT_HEADER, [])
    open(os.path.join(folder, "b.csv"), "w").close()
    assert read_raw_visits(spark, folder).collect() == []
    assert read_raw_visits(spark, os.path.join(folder, "b.csv")).collect() == []


def test_numbers_do_not_depend_on_the_cut_of_a_scan(spark, folder):
    """The rows are placed by one scan; however else the files and the stored rows are cut, the ids stay."""
    rows = [row(facility_name=f"n{i}", address="x" * 300) for i in range(600)]
    for k in range(6):
        extract(folder, f"{k}.csv", EXTRACT_HEADER, rows[100 * k:100 * (k + 1)])
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    try:
        spark.conf.set(keys[0], "8k")
        spark.conf.set(keys[2], "0")
        placed = with_file_place(spark.read.option("header", True).csv(folder))
        numbered = file_order_ids(placed, S.SOURCE_ID).toDF(*S.RAW_COLUMNS, S.SOURCE_ID)
        raw = read_raw_visits(spark, folder, multiline=False)
        spark.conf.set(keys[0], "1m")
        spark.conf.set(keys[1], "1")
        want = [r["facility_name"] for r in rows]
        assert names(numbered) == want and names(raw) == want
        spark.conf.set(keys[0], "3k")
        spark.conf.set(keys[1], "40")
        assert names(numbered) == want and names(raw) == want
    finally:
        for k in keys:
            spark.conf.unset(k)
