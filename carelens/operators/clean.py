"""Cleaning of the raw extract (C1) and the cleaned text export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.sources.csv import write_csv


def clean_visits(raw: DataFrame) -> DataFrame:
    """Typed, categorised visit rows; one output row per input row.

    Metric text -> double, patient counts -> int (``Not Applicable`` first
    made NULL), month/day/year text -> date, ZIP left-padded, and the
    comparison text mapped to ``performance_category``. Hidden columns
    (``temp_id``, ``_src``) pass through.
    """
    conv = {
        "zip_code": X.pad_zip("zip_code"),
        "denominator": X.lenient_double("denominator"),
        "score": X.lenient_double("score"),
        "lower_estimate": X.lenient_double("lower_estimate"),
        "higher_estimate": X.lenient_double("higher_estimate"),
        "number_of_patients": X.lenient_int(X.null_if_token("number_of_patients")),
        "number_of_patients_returned": X.lenient_int(X.null_if_token("number_of_patients_returned")),
        "start_date": X.parse_mdy("start_date"),
        "end_date": X.parse_mdy("end_date"),
    }
    cols = [conv[c].alias(c) if c in conv else F.col(c) for c in S.RAW_COLUMNS]
    cols.append(X.categorize("compared_to_national").alias("performance_category"))
    hidden = [c for c in (S.ROW_ID, S.SOURCE_ID) if c in raw.columns]
    return raw.select(*cols, *hidden)


def cleaned_text(visits: DataFrame) -> DataFrame:
    """The cleaned rows as exported: dates as day/month/year text."""
    cols = []
    for c in S.VISIT_COLUMNS:
        if c in ("start_date", "end_date"):
            cols.append(F.date_format(c, S.EXPORT_DATE_FORMAT).alias(c))
        else:
            cols.append(F.col(c))
    return visits.select(*cols)


def export_cleaned_csv(visits: DataFrame, path: str) -> str:
    """Write the cleaned export; NULL as an empty field."""
    return write_csv(cleaned_text(visits), path)
