"""The dashboard's data for one selection (national or one state).

One page load asks eight questions; here they share one pruned
``readmission facts x hospitals`` relation where the question allows it
(N4, N8, N9, N12 read it). With ``cache=True`` that relation is persisted,
so the fact is scanned once per page instead of once per question; it is
off by default because at full scale the relation is a large share of the
fact, and Parquet scans with partition pruning are cheap to repeat.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.plans import metrics as M
from carelens.operators.star import Star


def dashboard(star: Star, state: str | None = None, cache: bool = False) -> dict[str, DataFrame]:
    shared = (M.readmission_facts(star.performance_data)
              .select("performance_id", "facility_id", "measure_id", "score", "denominator")
              .join(M.hospitals_for(star, None, "state", "facility_name", "city_town"), "facility_id"))
    if cache:
        # MEMORY_AND_DISK: a lost block is recomputed from the stored tables.
        shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
    local = shared.filter(F.col("state") == state) if state else shared
    out = {
        "kpis": M.kpis(star, state),
        "national_performance": M.national_breakdown(star, state, order="category"),
        "performance_by_volume": M.volume_tiers_short_of(local, star.plain_scores),
        "top_hospitals": M.worst_hospitals(star, state),
        "worst_measures": M.worst_measures_of(
            local.join(star.measures.select("measure_id", "measure_name"), "measure_id"), plain=star.plain_scores),
        "performance_by_state": M.state_map_of(shared, plain=star.plain_scores),
        "state_details": M.state_details_of(shared, plain=star.plain_scores),
    }
    return out
