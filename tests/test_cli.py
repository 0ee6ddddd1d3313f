"""The command line: load an extract, write reports."""

import os
import tempfile

from carelens import schema as S
from carelens.__main__ import main
from carelens.sources.csv import read_text_table, write_csv
from carelens.sources.fixtures import EXTRACT_HEADER, raw_visits


def test_load_then_report(spark, sf001, capsys):
    base = tempfile.mkdtemp(prefix="carelens-cli-")
    raw = raw_visits(spark, sf001).select(*S.RAW_COLUMNS)
    write_csv(raw.toDF(*EXTRACT_HEADER), os.path.join(base, "extract"))
    star = os.path.join(base, "star")
    assert main(["load", "--raw", os.path.join(base, "extract"), "--star", star], spark) == 0
    out = capsys.readouterr().out
    assert f"performance_data={raw.count()}" in out

    assert main(["report", "--star", star, "--name", "kpis", "--state", "NATION_3",
                 "--out", os.path.join(base, "kpis"), "--format", "json"], spark) == 0
    row = spark.read.json(os.path.join(base, "kpis")).first()
    assert row.total_hospitals > 0

    assert main(["report", "--star", star, "--name", "state_details",
                 "--out", os.path.join(base, "csv")], spark) == 0
    assert os.path.isdir(os.path.join(base, "csv", "state_details_national.csv"))

    raw_path = os.path.join(base, "extract")
    assert main(["load", "--raw", raw_path, "--star", star, "--append"], spark) == 0
    out = capsys.readouterr().out
    assert f"performance_data={raw.count()}" in out and "hospitals=0" in out
    for name in ("national_breakdown_by_count", "worst_measures_overall", "volume_tiers_overall", "category_counts",
                 "metric_summary", "breakdown_check", "rank_relabel"):
        path = os.path.join(base, name)
        assert main(["report", "--star", star, "--name", name, "--out", path, "--format", "json"], spark) == 0
        assert spark.read.json(path).count() > 0
    assert main(["clean", "--raw", raw_path, "--out", os.path.join(base, "cleaned")], spark) == 0
    assert read_text_table(spark, os.path.join(base, "cleaned"), S.VISIT_COLUMNS).count() == raw.count()
    main(["report", "--star", star, "--name", "kpis", "--state", "NOWHERE", "--out", os.path.join(base, "none")], spark)
    shown = read_text_table(spark, os.path.join(base, "none", "kpis_NOWHERE.csv"), ["n", "score"]).first()
    assert tuple(shown) == ("0", "N/A")
