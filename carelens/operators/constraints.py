"""The keys of the star and the values lost in conversion, checked on a load.

The relational tables declare primary and foreign keys; files do not, so they
are checked: one report row per constraint, and the facts that break one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.operators.star import Star

PRIMARY = {"hospitals": "facility_id", "measures": "measure_id", "footnotes": "footnote_id", "performance_data": "performance_id"}
FOREIGN = [("performance_data", "facility_id", "hospitals"), ("performance_data", "measure_id", "measures"),
           ("performance_footnotes", "performance_id", "performance_data"), ("performance_footnotes", "footnote_id", "footnotes")]
CONVERTED = ["denominator", "score", "lower_estimate", "higher_estimate", "number_of_patients", "number_of_patients_returned",
             "start_date", "end_date"]


def _row(kind: str, table: str, column: str, violations: DataFrame) -> DataFrame:
    """``violations`` has one row with the number of rows that break the constraint."""
    return violations.select(F.lit(kind).alias("kind"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                             F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("violations"))


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key, and rows without a key (a footnote id may be unknown once)."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))


def orphans(star: Star, child: str, key: str, parent: str) -> DataFrame:
    """Rows of ``child`` whose key (if known) has no row in ``parent``."""
    known = getattr(star, child).filter(F.col(key).isNotNull())
    return known.join(getattr(star, parent).select(key).distinct(), key, "left_anti")


def rejected_facts(star: Star) -> DataFrame:
    """The facts that no report joined to dimensions counts, with the reason."""
    parts = [orphans(star, "performance_data", key, parent).select(
        "performance_id", "facility_id", "measure_id", "score", F.lit(f"unknown {key}").alias("reason"))
        for child, key, parent in FOREIGN if child == "performance_data"]
    return parts[0].unionByName(parts[1])


def lost_values(raw: DataFrame, visits: DataFrame, columns: list[str] = CONVERTED) -> DataFrame:
    """(kind, table_name, column_name, violations): texts, blanks and known missing-value
    tokens apart, that conversion made NULL. Both tables carry ``temp_id``."""
    text = raw.select(S.ROW_ID, *[F.col(c).alias(f"{c}_text") for c in columns])
    both = visits.select(S.ROW_ID, *columns).join(text, S.ROW_ID)
    lost = [F.count_if(F.col(c).isNull() & (F.trim(f"{c}_text") != "") & ~F.col(f"{c}_text").isin(S.NOT_APPLICABLE, "Not Available")).alias(c) for c in columns]
    return both.agg(*lost).select(F.explode(F.array(*[
        F.struct(F.lit("lost in conversion").alias("kind"), F.lit("performance_data").alias("table_name"), F.lit(c).alias("column_name"),
                 F.col(c).alias("violations")) for c in columns])).alias("x")).select("x.*")


def load_constraints(star: Star) -> DataFrame:
    """One row per key constraint with the rows that break it."""
    rows = [_row("primary key", t, k, duplicate_keys(getattr(star, t), k)) for t, k in PRIMARY.items()]
    rows += [_row("foreign key", c, k, orphans(star, c, k, p).agg(F.count(F.lit(1)).alias("n"))) for c, k, p in FOREIGN]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
