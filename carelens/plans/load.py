"""The load job: raw extract -> row ids -> cleaned visits -> star.

The raw rows get their dense position first (the order key is defined on
the raw text); cleaning is row-preserving, so the id is carried through.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.clean import clean_visits
from carelens.operators.keys import dense_row_ids
from carelens.operators.star import Star, build_star


def numbered_visits(raw: DataFrame, order_cols: list[str], start: int = 0,
                    num_partitions: int | None = None) -> DataFrame:
    """Cleaned visits with ``temp_id``: positions 1..N in ``order_cols`` order.

    ``_src`` is appended to the order as the last tie-break, so the key is
    unique and groups of identical rows still spread over partitions. Without
    ``order_cols`` the file order, which ``_src`` of a CSV read holds, is kept:
    nothing is sorted or shuffled.
    """
    if not order_cols:
        return clean_visits(raw.withColumn(S.ROW_ID, F.col(S.SOURCE_ID) + F.lit(start)))
    order = list(order_cols)
    if S.SOURCE_ID in raw.columns and S.SOURCE_ID not in order:
        order.append(S.SOURCE_ID)
    numbered = dense_row_ids(raw, order, id_col=S.ROW_ID, start=start,
                             num_partitions=num_partitions)
    return clean_visits(numbered)


def star_from_raw(raw: DataFrame, order_cols: list[str],
                  existing_footnotes: DataFrame | None = None, start: int = 0) -> Star:
    return build_star(numbered_visits(raw, order_cols, start=start), existing_footnotes)


# --- the driver's tables ------------------------------------------------------

# Per application, checkpoint folder and data folder; one builder at a time.
_LOCK = threading.RLock()
_STORED: dict[tuple[str, ...], Star] = {}
_NUMBERED: dict[tuple[str, str, str], DataFrame] = {}


def fixture_visits(spark, sf_dir: str) -> DataFrame:
    """Cleaned visits over the driver's tables, without row ids (C1 only)."""
    from carelens.sources.fixtures import raw_visits
    return clean_visits(raw_visits(spark, sf_dir))


def fixture_numbered_visits(spark, sf_dir: str) -> DataFrame:
    """Cleaned visits with row ids; the numbering job runs once per process
    and data folder (its output is a stored table, the result reads it)."""
    from carelens.session import checkpoint_dir
    from carelens.sources.fixtures import ORDER_KEY, raw_visits
    key = (spark.sparkContext.applicationId, checkpoint_dir(spark), sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _NUMBERED:
            _NUMBERED[key] = numbered_visits(raw_visits(spark, sf_dir), ORDER_KEY)
        return _NUMBERED[key]


def fixture_star(spark, sf_dir: str) -> Star:
    """The star built from the driver's tables, lazily (nothing stored)."""
    return build_star(fixture_numbered_visits(spark, sf_dir), by_facility=True)


def stored_fixture_star(spark, sf_dir: str) -> Star:
    """The star built once per process and data folder, written as Parquet in
    the shared scratch folder, then read back: the reports run on stored
    tables, as they would after a load."""
    from carelens.session import checkpoint_dir, scratch_path
    from carelens.sources.tables import load_star, save_star
    key = (spark.sparkContext.applicationId, checkpoint_dir(spark), sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _STORED:
            path = scratch_path(spark, "star")
            save_star(fixture_star(spark, sf_dir), path)
            _STORED[key] = load_star(spark, path)
        return _STORED[key]


def appended_fixture_star(spark, sf_dir: str) -> Star:
    """The star of the driver's tables loaded in two parts, the second appended."""
    from carelens.plans.append import append_star
    from carelens.session import checkpoint_dir, scratch_path
    from carelens.sources.fixtures import ORDER_KEY, halves, raw_visits
    from carelens.sources.tables import load_star
    key = (spark.sparkContext.applicationId, checkpoint_dir(spark), sf_dir.rstrip("/"), "appended")
    with _LOCK:
        if key not in _STORED:
            path = scratch_path(spark, "appended_star")
            for part in halves(raw_visits(spark, sf_dir)):
                append_star(spark, path, lambda start, raw=part: numbered_visits(raw, ORDER_KEY, start=start), by_facility=True)
            _STORED[key] = load_star(spark, path)
        return _STORED[key]
