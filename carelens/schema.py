"""Schemas, labels and bounds shared by the cleaning, load and report code."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Column names of the raw extract after snake_case normalisation, in file order.
RAW_COLUMNS = [
    "facility_id", "facility_name", "address", "city_town", "state", "zip_code",
    "county_parish", "telephone_number", "measure_id", "measure_name",
    "compared_to_national", "denominator", "score", "lower_estimate",
    "higher_estimate", "number_of_patients", "number_of_patients_returned",
    "footnote", "start_date", "end_date",
]
# Missing-value token replaced before the integer conversion.
NOT_APPLICABLE = "Not Applicable"
# Category rules, first match wins (case-sensitive substring -> label).
CATEGORY_RULES = [
    ("No Different", "Average"),
    ("Better", "Better than National Average"),
    ("Worse", "Worse than National Average"),
]
# Rank relabelling labels (validation step), in rank order.
RANK_LABELS = [
    "Better than National Average",
    "National Average",
    "Worse than National Average",
]
# Readmission measure families: measure_id prefixes.
READMISSION_PREFIXES = ["READM", "EDAC"]
# Heart-failure readmission measure used by the worst-hospitals report.
HEART_FAILURE_MEASURE = "READM_30_HF"
# Volume tiers on denominator: upper bounds (inclusive), then the open tier.
VOLUME_BOUNDS = [100, 500, 1000]
VOLUME_LABELS_LONG = [
    "Small (<= 100 cases)",
    "Medium (101-500 cases)",
    "Large (501-1000 cases)",
    "Very Large (> 1000 cases)",
]
VOLUME_LABELS_SHORT = ["Small", "Medium", "Large", "Very Large"]
# Footnote list separator inside one cell.
FOOTNOTE_SEPARATOR = ", "
# Minimum number of distinct facilities for a state to be reported.
STATE_MIN_HOSPITALS = 20
# Length of the top-k reports.
TOP_K = 5
# ZIP code width (left-padded with zeros).
ZIP_WIDTH = 5
# Export format of dates: day/month/year.
EXPORT_DATE_FORMAT = "dd/MM/yyyy"
# Columns of the star tables, in order.
HOSPITAL_COLUMNS = [
    "facility_id", "facility_name", "address", "city_town", "state", "zip_code",
    "county_parish", "telephone_number",
]
MEASURE_COLUMNS = ["measure_id", "measure_name"]
FACT_COLUMNS = [
    "facility_id", "measure_id", "denominator", "score", "lower_estimate",
    "higher_estimate", "number_of_patients", "number_of_patients_returned",
    "performance_category", "start_date", "end_date",
]
# Default export name when no state is selected.
NATIONAL = "national"
# ---------------------------------------------------------------------------

# Date texts read: month/day/year with four-digit, then two-digit years; of the
# latter 69 on are 19xx, else 20xx.
INPUT_DATE_FORMATS = ["M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
INPUT_DATE_FORMATS_2DIGIT = ["M/d/yy", "M-d-yy", "M.d.yy"]
TWO_DIGIT_YEAR_CUTOFF = 69

# Raw extract: every column is text on read (numbers mix with tokens).
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Cleaned visit row: the raw columns with typed metrics plus the category.
VISIT_COLUMNS = RAW_COLUMNS + ["performance_category"]

# Hidden columns carried through the pipeline.
ROW_ID = "temp_id"      # dense 1..N row position (becomes performance_id)
SOURCE_ID = "_src"      # unique source row identity (tie-break only)

# Stored star tables (column DDL, without partition columns).
STAR_DDL = {
    "hospitals": ", ".join(f"{c} string" for c in HOSPITAL_COLUMNS),
    "measures": "measure_id string, measure_name string",
    "footnotes": "footnote_id int, footnote_text string",
    "performance_data": (
        "performance_id bigint, facility_id string, measure_id string, denominator double, "
        "score double, lower_estimate double, higher_estimate double, number_of_patients int, "
        "number_of_patients_returned int, performance_category string, start_date date, "
        "end_date date"),
    "performance_footnotes": "performance_id bigint, footnote_id int",
}
