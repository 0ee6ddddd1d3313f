"""Adding an extract to a stored star (S5, C5-C9, J6): the one append path.

Row ids continue after those that other loads stored or claimed; facilities and
measures already stored keep their first row and only new keys are added; only
footnote ids not stored yet are added (NULL matches NULL). A load that is run
again under its ``load_id`` replaces its own rows and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.joins import null_safe_anti_join
from carelens.operators.star import Star, build_star
from carelens.sources.commits import LoadLog
from carelens.sources.tables import load_star, new_part, star_exists, stored_parts, write_part, write_table

KEYS = {"hospitals": "facility_id", "measures": "measure_id"}


def new_rows(visits: DataFrame, stored: Star | None, by_facility: bool = False) -> Star:
    """The star rows that numbered ``visits`` add to ``stored``."""
    star = build_star(visits, stored.footnotes if stored else None, by_facility)
    if stored is None:
        return star
    return star.replace(**{n: null_safe_anti_join(getattr(star, n), getattr(stored, n), k) for n, k in KEYS.items()})


def append_star(spark: SparkSession, star_path: str, visits_from: Callable[[int], DataFrame],
                load_id: str | None = None, write: Callable = write_table, by_facility: bool = False) -> dict[str, int]:
    """Add one extract to the star at ``star_path`` (made if there is none yet).

    ``visits_from(0)`` gives the cleaned visits numbered from 1; the load's
    first id follows the range that it claims in the star's commit log, so
    loads that run at once have disjoint ids. The rows are visible in all
    tables when the load is committed. If another load was committed in the
    meantime, the new facilities, measures and footnotes are found again.
    A load that failed can be run again under its ``load_id``: it has the ids
    it had, and what it wrote before is never seen. ``by_facility``: the visits
    are numbered by facility, so their facts need no shuffle to be stored so.
    Returns the rows this load added to each table (S10).
    """
    load_id = load_id or uuid.uuid4().hex
    log = LoadLog(spark, star_path)
    if not log.exists() and star_exists(spark, star_path):
        there = load_star(spark, star_path, check=False)
        last = there.performance_data.agg(F.max("performance_id")).first()[0] or 0
        log.commit(0, stored_parts(spark, star_path), last)
    visits = visits_from(0)
    rows = visits.select(S.ROW_ID).count()
    while True:
        version = log.state().version
        stored = load_star(spark, star_path, check=False, without_load=load_id) if version else None
        start = log.claim(load_id, rows)
        star = new_rows(visits.withColumn(S.ROW_ID, F.col(S.ROW_ID) + F.lit(start)), stored, by_facility)
        part = new_part(load_id)
        counts, fact = write_part(star, star_path, part, write=write)
        if log.commit(version, {load_id: part}, start + rows, rows=counts, facts=fact):
            return counts
