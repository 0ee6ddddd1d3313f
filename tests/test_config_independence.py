"""Results do not depend on session settings the driver may choose."""

from carelens.plans import load as L
from tests.oracle_check import compare

SETTINGS = {
    "spark.sql.shuffle.partitions": "37",
    "spark.sql.session.timeZone": "America/New_York",
    "spark.sql.ansi.enabled": "false",
}


def test_queries_match_under_other_settings(spark, sf001):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    stored, numbered = dict(L._STORED), dict(L._NUMBERED)
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        L._STORED.clear()
        L._NUMBERED.clear()   # the load runs again under these settings
        rep = compare(spark, sf001, verbose=False)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        L._STORED.clear()
        L._NUMBERED.clear()
        L._STORED.update(stored)
        L._NUMBERED.update(numbered)
    assert [k for k, v in rep.items() if not v.get("values_match")] == []
