"""Extracts are written compressed and read back whole."""

import glob

from carelens import schema as S
from carelens.session import scratch_path
from carelens.sources import fixtures as FX
from carelens.sources.csv import read_raw_visits


def test_extracts_are_compressed_and_read_whole(spark, sf001):
    raw = FX.raw_visits(spark, sf001).select(*S.RAW_COLUMNS)
    path = scratch_path(spark, "gz_extract")
    FX.mixed_extract(raw, path)
    files = glob.glob(f"{path.removeprefix('file:')}/*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = read_raw_visits(spark, f"{path}/*", optional=("county_parish",))
    columns = [c for c in S.RAW_COLUMNS if c != "county_parish"]  # one of the files lacks it
    assert back.select(*columns).exceptAll(raw.select(*columns)).isEmpty() and back.count() == raw.count()
