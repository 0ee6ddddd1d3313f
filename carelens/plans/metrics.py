"""The reporting questions over the star schema.

Each function takes a :class:`~carelens.operators.star.Star` and returns a
lazy DataFrame. ``state`` is optional everywhere it applies: ``None`` or
``""`` means national. Joins carry no hints: the planner broadcasts a side
whose measured bytes are small and shuffles otherwise (AQE splits skewed
facility partitions). No job runs while a report is built. Top-k reports break
ties on the name columns so their rows are repeatable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.operators.joins import scan_filter
from carelens.operators.star import Star
from carelens.sources.tables import FAMILY_COLUMN


def _group(df: DataFrame, keys: list[str], sets: list[list[str]] | None, *more: str):
    if sets is None:
        return df.groupBy(*keys, *more)
    return df.groupingSets([[F.col(c) for c in [*s, *more]] for s in sets], *[F.col(c) for c in [*keys, *more]])


def grouped_mean(facts: DataFrame, keys: list[str], value: str, name: str, *aggs: Column, plain: bool = False,
                 sets: list[list[str]] | None = None) -> DataFrame:
    """``keys``, ``aggs`` and ``name`` = ROUND(AVG(value), 2), half away from zero, as a double.

    The sum is exact (:mod:`carelens.functions.exact`), so it does not depend on
    the order in which partitions are added. Plain numbers are summed with the
    other aggregates; wide ones, if there may be any, by a second pass over them
    alone. ``plain`` says that there are none (the load counted them): then
    there is no second pass, and a wide number is an error, never a wrong mean.
    With ``sets``, the grouping sets of ``keys``; ``all_<key>`` tells the rows
    in which a key stands for all its values.
    """
    x = F.col(value)
    marks = [F.grouping(k).cast("boolean").alias(f"all_{k}") for k in keys] if sets else []
    main = _group(facts, keys, sets).agg(*aggs, *marks, F.sum(X.plain_part(x)).alias("_sum"), F.count(x).alias("_n"), F.count_if(X.is_wide(x)).alias("_wide"))
    simple = F.round(F.col("_sum") / F.col("_n").cast("decimal(20,0)"), 2).cast("double")
    shown = [c for c in main.columns if c not in ("_sum", "_n", "_wide")]
    if plain:
        checked = F.when(F.col("_wide") > 0, F.raise_error(F.lit(f"{value}: numbers that the load did not count"))).otherwise(simple)
        return main.select(*shown, checked.alias(name))
    bucket, digits = X.bucket_and_digits(x)
    by = [*keys, *(f"all_{k}" for k in keys if sets)]
    wide = (_group(facts.filter(X.is_wide(x)).select(*keys, bucket.alias("bucket"), digits.alias("digits")), keys, sets, "bucket")
            .agg(F.sum("digits").alias("digits"), *marks)
            .groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.collect_list(F.struct("bucket", "digits")).alias("_buckets")))
    both = main.join(wide, reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), by, F.lit(True)), "left")
    return both.select(*shown, F.when(F.col("_wide") > 0, X.rounded_mean(X.with_plain_part(F.col("_buckets"), F.col("_sum")), F.col("_n")))
                       .otherwise(simple).alias(name))


def overall_mean(facts: DataFrame, value: str, plain: bool = False) -> Column:
    """The mean over all rows as a scalar subquery (NULL without rows)."""
    one = F.coalesce(F.col(value) * 0, F.lit(0))  # not a literal: the join on it stays an equi-join
    return grouped_mean(facts.withColumn("all", one), ["all"], value, "mean", plain=plain).select("mean").scalar()


def readmission_facts(df: DataFrame) -> DataFrame:
    """score IS NOT NULL and measure_id in the readmission families.

    On a stored fact the same test on the partition column prunes folders.
    """
    cond = F.col("score").isNotNull() & X.is_readmission("measure_id")
    if FAMILY_COLUMN in df.columns:
        cond = cond & F.col(FAMILY_COLUMN).isin(*S.READMISSION_PREFIXES)
    return df.filter(cond)


def hospitals_for(star: Star, state: str | None, *cols: str) -> DataFrame:
    """facility_id plus ``cols`` of the hospitals, of one state if given, ready to join."""
    h = star.hospitals.filter(F.col("state") == state) if state else star.hospitals
    return h.select("facility_id", *[c for c in cols if c != "facility_id"])


# --- N1, N2 -----------------------------------------------------------------

def national_breakdown(star: Star, state: str | None = None, order: str = "count") -> DataFrame:
    """Category counts and their share of all categorised facts.

    The share's base counts every non-NULL category, ``''`` included, and
    stays national when a state is given. ``order='count'`` sorts by count
    (the stand-alone query), ``order='category'`` by label (the dashboard).
    """
    cat = F.col("performance_category")
    facts = star.performance_data.filter(cat.isNotNull())
    if not state:
        # One scan: group every non-NULL category, total over the grouped rows.
        grouped = facts.groupBy("performance_category").agg(
            F.count(F.lit(1)).alias("number_of_measures"))
        total = F.sum("number_of_measures").over(Window.partitionBy())
        out = grouped.withColumn("percentage", X.mysql_share_percent("number_of_measures", total))
        out = out.filter(cat != "")
    else:
        base = facts.agg(F.count(F.lit(1))).scalar()
        j = (facts.filter(cat != "").select("facility_id", "performance_category")
             .join(hospitals_for(star, state), "facility_id"))
        out = (j.groupBy("performance_category")
               .agg(F.count(F.lit(1)).alias("number_of_measures"))
               .withColumn("percentage", X.mysql_share_percent("number_of_measures", base)))
    if order == "count":
        return out.orderBy(F.desc("number_of_measures"), "performance_category")
    return out.orderBy("performance_category")


# --- N3, N4 -----------------------------------------------------------------

def worst_measures(star: Star, state: str | None = None, join_hospitals: bool = False,
                   k: int = S.TOP_K) -> DataFrame:
    """Readmission measures with the highest average score, by name.

    The stand-alone form joins measures only; the dashboard form always joins
    hospitals too (so facts of unknown facilities drop) and takes a state.
    """
    f = readmission_facts(star.performance_data).select(
        "performance_id", "facility_id", "measure_id", "score")
    if join_hospitals or state:
        f = f.join(hospitals_for(star, state), "facility_id")
    return worst_measures_of(f.join(star.measures.select("measure_id", "measure_name"),
                                    "measure_id"), k, star.plain_scores)


def worst_measures_of(facts: DataFrame, k: int = S.TOP_K, plain: bool = False) -> DataFrame:
    """N3/N4 aggregation over readmission facts that carry ``measure_name``."""
    return (grouped_mean(facts, ["measure_name"], "score", "average_score",
                         F.count("performance_id").alias("number_of_hospitals_reporting"), plain=plain)
            .orderBy(F.desc("average_score"), "measure_name")
            .limit(k))


# --- N5, N6 -----------------------------------------------------------------

def worst_hospitals(star: Star, state: str | None = None,
                    measure_id: str = S.HEART_FAILURE_MEASURE, k: int = S.TOP_K) -> DataFrame:
    """Distinct (facility, city, state, score) rows with the highest score."""
    f = (star.performance_data
         .filter((F.col("measure_id") == measure_id) & F.col("score").isNotNull())
         .select("facility_id", "score"))
    h = hospitals_for(star, state, "facility_name", "city_town", "state")
    return (f.join(h, "facility_id")
            .select("facility_name", "city_town", "state", "score")
            .distinct()
            .orderBy(F.desc("score"), "facility_name", "city_town", "state")
            .limit(k))


# --- N7, N8, N9 -------------------------------------------------------------

def _by_state(star: Star) -> DataFrame:
    f = readmission_facts(star.performance_data).select("facility_id", "score", "denominator")
    return f.join(hospitals_for(star, None, "state"), "facility_id")


def state_scores(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """Average readmission score per state with enough facilities."""
    return (grouped_mean(_by_state(star), ["state"], "score", "average_state_score",
                         F.count_distinct("facility_id").alias("number_of_hospitals"), plain=star.plain_scores)
            .filter(F.col("number_of_hospitals") > min_hospitals)
            .orderBy(F.desc("average_state_score"), "state"))


def state_map(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """Per-state average for the map; the facility count only filters."""
    return state_map_of(_by_state(star), min_hospitals, star.plain_scores)


def state_map_of(facts: DataFrame, min_hospitals: int = S.STATE_MIN_HOSPITALS, plain: bool = False) -> DataFrame:
    """N8 aggregation over readmission facts that carry ``state``."""
    return (grouped_mean(facts, ["state"], "score", "average_state_score", F.count_distinct("facility_id").alias("_places"), plain=plain)
            .filter(F.col("_places") > min_hospitals)
            .drop("_places"))


def state_details(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """Per-state facility count, volume, score range and average."""
    return state_details_of(_by_state(star), min_hospitals, star.plain_scores)


def state_details_of(facts: DataFrame, min_hospitals: int = S.STATE_MIN_HOSPITALS, plain: bool = False) -> DataFrame:
    """N9 aggregation over readmission facts that carry ``state``."""
    return (grouped_mean(facts, ["state"], "score", "average_score",
                         F.count_distinct("facility_id").alias("number_of_hospitals"),
                         F.sum("denominator").alias("total_patient_volume"),
                         F.min("score").alias("min_score"), F.max("score").alias("max_score"), plain=plain)
            .filter(F.col("number_of_hospitals") > min_hospitals)
            .orderBy(F.desc("average_score"), "state"))


# --- N10 --------------------------------------------------------------------

def common_footnotes(star: Star, k: int = S.TOP_K) -> DataFrame:
    """Most frequent footnotes of the links, text from a left join.

    Links are counted per id before the join (a few rows leave the shuffle
    however many links there are); summing after the join keeps the result
    equal to joining first even if the footnotes table repeated an id.
    """
    per_id = star.performance_footnotes.groupBy("footnote_id").agg(F.count(F.lit(1)).alias("_c"))
    j = per_id.join(star.footnotes.select("footnote_id", "footnote_text"), "footnote_id", "left")
    return (j.groupBy("footnote_id", "footnote_text")
            .agg(F.sum("_c").cast("long").alias("frequency"))
            .orderBy(F.desc("frequency"), F.asc_nulls_first("footnote_id"),
                     F.asc_nulls_first("footnote_text"))
            .limit(k))


# --- N11, N12 ---------------------------------------------------------------

def volume_tiers(star: Star) -> DataFrame:
    """Average score per volume tier, long labels, no hospitals join."""
    f = readmission_facts(star.performance_data).filter(F.col("denominator").isNotNull())
    tiers = f.select(X.volume_tier("denominator", S.VOLUME_LABELS_LONG).alias("hospital_volume_tier"), "score")
    return (grouped_mean(tiers, ["hospital_volume_tier"], "score", "average_score",
                         F.count(F.lit(1)).alias("number_of_measures"), plain=star.plain_scores)
            .orderBy("average_score", "hospital_volume_tier"))


def volume_tiers_by_state(star: Star, state: str | None = None) -> DataFrame:
    """Average score per volume tier, short labels, hospitals always joined."""
    f = (readmission_facts(star.performance_data).filter(F.col("denominator").isNotNull())
         .select("facility_id", "denominator", "score")
         .join(hospitals_for(star, state), "facility_id"))
    return volume_tiers_short_of(f, star.plain_scores)


def volume_tiers_short_of(facts: DataFrame, plain: bool = False) -> DataFrame:
    """N12 aggregation over readmission facts joined to hospitals."""
    tiers = (facts.filter(F.col("denominator").isNotNull())
             .select(X.volume_tier("denominator", S.VOLUME_LABELS_SHORT).alias("tier"), "score"))
    return grouped_mean(tiers, ["tier"], "score", "average_score", plain=plain).orderBy("tier")


# --- N13 --------------------------------------------------------------------

def hospital_profile(star: Star, facility_name: str) -> DataFrame:
    """Every fact of one named facility with its measure name.

    Rows with a NULL score are kept. The ids of the name reach the scan as a
    filter; a stored fact lies by facility, so few of its row groups are read.
    """
    named = star.hospitals.filter(F.col("facility_name") == facility_name).select("facility_id")
    f = star.performance_data.filter(scan_filter("facility_id", named)).select(
        "facility_id", "measure_id", "score", "performance_category", "denominator",
        "number_of_patients_returned")
    return (f.join(named, "facility_id")
            .join(star.measures.select("measure_id", "measure_name"), "measure_id")
            .select("measure_name", "score", "performance_category", "denominator",
                    "number_of_patients_returned")
            .orderBy("measure_name", F.desc_nulls_last("score")))


# --- N14, N15 ---------------------------------------------------------------

def kpi_summary(star: Star) -> DataFrame:
    """Facility and measure counts from the dimensions and the national
    readmission average without a hospitals join, as one row (N14, U2)."""
    measures = star.measures.agg(F.count_distinct("measure_id")).scalar()
    avg = overall_mean(readmission_facts(star.performance_data), "score", star.plain_scores)
    return star.hospitals.agg(F.count_distinct("facility_id").alias("total_hospitals")).select(
        "total_hospitals", measures.alias("total_measures"),
        avg.alias("average_readmission_score"))


def kpis(star: Star, state: str | None = None) -> DataFrame:
    """Facility count and readmission average, hospitals joined, optional state.

    No match gives one row with 0 and NULL.
    """
    h = star.hospitals
    if state:
        h = h.filter(F.col("state") == state)
    f = (readmission_facts(star.performance_data).select("facility_id", "score")
         .join(hospitals_for(star, state), "facility_id"))
    avg = overall_mean(f, "score", star.plain_scores)
    return h.agg(F.count_distinct("facility_id").alias("total_hospitals")).select(
        "total_hospitals", avg.alias("average_readmission_score"))
