"""Result exports: a report table as quoted CSV (S8), rows as JSON.

The CSV holds what the page's table shows: counts with thousands separators
(X18), scores with two decimals (X17). The folder is named
``{table}_{state or 'national'}`` (X19). Cells are all quoted; inner quotes
are escaped by doubling (the page wrote them unescaped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.sources.csv import write_csv

# column -> display format for the state performance table
STATE_DETAILS_FORMATS = {
    "number_of_hospitals": "thousands",
    "total_patient_volume": "thousands",
    "min_score": "two_decimals",
    "max_score": "two_decimals",
    "average_score": "two_decimals",
}
WORST_MEASURES_FORMATS = {"number_of_hospitals_reporting": "thousands", "average_score": "two_decimals"}
TOP_HOSPITALS_FORMATS = {"score": "two_decimals"}
STATE_SCORES_FORMATS = {"number_of_hospitals": "thousands", "average_state_score": "two_decimals"}
KPI_FORMATS = {"total_hospitals": "thousands", "average_readmission_score": "or_na"}

# report name -> display formats of its exported table
REPORT_FORMATS = {
    "worst_measures": WORST_MEASURES_FORMATS, "worst_measures_overall": WORST_MEASURES_FORMATS,
    "worst_hospitals": TOP_HOSPITALS_FORMATS, "state_scores": STATE_SCORES_FORMATS,
    "state_details": STATE_DETAILS_FORMATS, "kpis": KPI_FORMATS,
}

# Label shown for a missing headline value.
NOT_AVAILABLE_LABEL = "N/A"


def _or_na(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NOT_AVAILABLE_LABEL))


_FORMATTERS = {"thousands": X.thousands, "two_decimals": X.two_decimals, "or_na": _or_na}


def export_name(table: str, state: str | None) -> str:
    return f"{table}_{state or S.NATIONAL}"


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    return df.select(*[
        _FORMATTERS[formats[c]](c).alias(c) if c in formats else F.col(c).cast("string").alias(c)
        for c in df.columns])


def export_table_csv(df: DataFrame, base: str, table: str, state: str | None = None,
                     formats: dict[str, str] | None = None) -> str:
    """Write the displayed table as CSV with a header, every cell quoted."""
    path = f"{base.rstrip('/')}/{export_name(table, state)}.csv"
    return write_csv(formatted(df, formats or {}), path, quote_all=True)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Rows as JSON lines; NULL fields are kept as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, computed on the executors."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
