"""Star schema from cleaned visits.

``visits`` must carry ``temp_id``, the dense row position (see
:mod:`carelens.operators.keys`). The fact keeps it as ``performance_id``
and the junction reuses it directly, instead of reading generated keys back
and pairing them by position.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.operators.dedup import first_row_per_key
from carelens.operators.joins import null_safe_anti_join


@dataclass
class Star:
    hospitals: DataFrame
    measures: DataFrame
    footnotes: DataFrame
    performance_data: DataFrame
    performance_footnotes: DataFrame
    #: the loads counted no score that is not plain (see carelens.functions.exact)
    plain_scores: bool = False
    #: the loads' partial results by facility (see carelens.plans.states), if stored
    facility_state: DataFrame | None = None
    #: the facts come in files that each hold the rows of a few facilities (visits numbered by facility)
    by_facility: bool = False

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)[:5]}

    def replace(self, **changes: DataFrame) -> "Star":
        """A star with some tables swapped; of another fact nothing is known."""
        if "performance_data" in changes:
            changes = {"plain_scores": False, "facility_state": None, "by_facility": False} | changes
        return replace(self, **changes)


def hospitals_dim(visits: DataFrame) -> DataFrame:
    """One row per facility, attributes from its first row."""
    return first_row_per_key(visits, "facility_id", S.HOSPITAL_COLUMNS, S.ROW_ID)


def measures_dim(visits: DataFrame) -> DataFrame:
    """One row per measure, name from its first row."""
    return first_row_per_key(visits, "measure_id", S.MEASURE_COLUMNS, S.ROW_ID)


def footnote_ids(visits: DataFrame) -> DataFrame:
    """All footnote ids: split the lists, then drop blanks, distinct, cast.

    Distinct runs on the text and again on the id, since two texts (``1`` and
    ``01``) can give one id and the id is the table key. Each distinct is a
    partial + final aggregate, so a dominant footnote is combined map-side.
    """
    # Blank cells yield only blank parts, so dropping them before the split
    # changes nothing but spares one generated row per blank cell.
    cells = visits.filter(F.col("footnote") != "")
    parts = cells.select(F.explode(F.split("footnote", S.FOOTNOTE_SEPARATOR)).alias("footnote"))
    texts = parts.filter((F.col("footnote") != "") & F.col("footnote").isNotNull()).distinct()
    return (texts.select(X.lenient_int("footnote").alias("footnote_id")).distinct()
            .select("footnote_id", F.lit(None).cast("string").alias("footnote_text")))


def new_footnotes(all_footnotes: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Footnote rows whose id is not stored yet (C7 + J6, NULL matches NULL)."""
    if existing is None:
        return all_footnotes
    return null_safe_anti_join(all_footnotes, existing, "footnote_id")


def performance_fact(visits: DataFrame) -> DataFrame:
    """The fact table with its generated key."""
    return visits.select(F.col(S.ROW_ID).alias("performance_id"), *S.FACT_COLUMNS)


def performance_footnotes(visits: DataFrame) -> DataFrame:
    """Fact-footnote links: drop blank cells, then split, then cast.

    The reverse order of :func:`footnote_ids`: a cell such as ``"1, "``
    yields a NULL id here and no id there.
    """
    kept = visits.filter((F.col("footnote") != "") & F.col("footnote").isNotNull())
    parts = kept.select(
        F.col(S.ROW_ID).alias("performance_id"),
        F.explode(F.split("footnote", S.FOOTNOTE_SEPARATOR)).alias("_fn"))
    return parts.select("performance_id", X.lenient_int("_fn").alias("footnote_id"))


def build_star(visits: DataFrame, existing_footnotes: DataFrame | None = None, by_facility: bool = False) -> Star:
    """All five tables, lazily. ``existing_footnotes`` limits footnotes to new ids.
    ``by_facility`` says that the visits were numbered and stored by facility."""
    return Star(
        hospitals=hospitals_dim(visits),
        measures=measures_dim(visits),
        footnotes=new_footnotes(footnote_ids(visits), existing_footnotes),
        performance_data=performance_fact(visits),
        performance_footnotes=performance_footnotes(visits),
        by_facility=by_facility,
    )
