"""The dashboard's tables for the nation and every state at once.

The dashboard asks state by state; here one pass over the readmission facts
with grouping sets gives all averages, and the five worst of each state come
from one window per table, cut to five rows per state and task before the
rows meet. One long table: ``scope`` (``national`` or the state), ``section``,
``item``, ``rank``, ``number``, ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.operators.star import Star
from carelens.plans.metrics import grouped_mean, readmission_facts

COLUMNS = ["scope", "section", "item", "rank", "number", "value"]


def _rows(df: DataFrame, section: str, scope, item, number, value) -> DataFrame:
    return df.select(scope.alias("scope"), F.lit(section).alias("section"), item.cast("string").alias("item"),
                     F.lit(None).cast("int").alias("rank"), number.cast("long").alias("number"), value.cast("double").alias("value"))


def _worst(df: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each scope by value, then item."""
    order = Window.partitionBy("scope").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*COLUMNS)


def breakdown_by_state(star: Star) -> DataFrame:
    """Counts per category, nationally (all facts) and per state; the share's base stays national."""
    facts = star.performance_data.filter(F.col("performance_category").isNotNull()).select("facility_id", "performance_category")
    base = facts.agg(F.count(F.lit(1))).scalar()
    placed = facts.filter(F.col("performance_category") != "").join(star.hospitals.select("facility_id", "state"), "facility_id", "left")
    counts = placed.groupingSets([[F.col("performance_category")], [F.col("state"), F.col("performance_category")]],
                                 F.col("state"), F.col("performance_category")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("state").cast("boolean").alias("national"))
    known = counts.filter("national OR state IS NOT NULL")  # facts of unknown facilities have no state
    return _rows(known, "breakdown", _scope(F.col("national"), F.col("state")), F.col("performance_category"), F.col("n"),
                 X.mysql_share_percent("n", base))


def _scope(national, state):
    return F.when(national, F.lit(S.NATIONAL)).otherwise(state)


def averages(star: Star) -> DataFrame:
    """N12, the mean of N15 and N4 in one grouping-sets pass over the readmission facts of known facilities."""
    facts = (readmission_facts(star.performance_data).select("performance_id", "facility_id", "measure_id", "score", "denominator")
             .join(star.hospitals.select("facility_id", "state"), "facility_id")
             .join(star.measures.select("measure_id", F.struct("measure_name").alias("measure")), "measure_id", "left")
             .select("state", "measure", F.when(F.col("denominator").isNotNull(), X.volume_tier("denominator", S.VOLUME_LABELS_SHORT)).alias("tier"),
                     "performance_id", "score"))
    sets = [[], ["state"], ["tier"], ["state", "tier"], ["measure"], ["state", "measure"]]
    return grouped_mean(facts, ["state", "tier", "measure"], "score", "mean", F.count("performance_id").alias("n"),
                        plain=star.plain_scores, sets=sets).filter("all_state OR state IS NOT NULL")


def worst_hospitals_by_state(star: Star, k: int = S.TOP_K) -> DataFrame:
    """N6 for the nation and every state: distinct (facility, city, state, score) rows with the highest scores."""
    facts = star.performance_data.filter((F.col("measure_id") == S.HEART_FAILURE_MEASURE) & F.col("score").isNotNull()).select("facility_id", "score")
    rows = facts.join(star.hospitals.select("facility_id", "facility_name", "city_town", "state"), "facility_id").select(
        "facility_name", "city_town", "state", "score").distinct()
    item = F.concat_ws(" | ", "facility_name", "city_town", "state")
    scoped = rows.select("*", F.explode(F.array_compact(F.array(F.lit(S.NATIONAL), "state"))).alias("scope"))
    return _worst(_rows(scoped, "worst_hospitals", F.col("scope"), item, F.lit(None), F.col("score")), k)


def dashboard_all_states(star: Star, k: int = S.TOP_K) -> DataFrame:
    """All sections for ``national`` and every state that has rows."""
    means = averages(star)
    scope = _scope(F.col("all_state"), F.col("state"))
    tiers = means.filter("NOT all_tier AND tier IS NOT NULL")
    measures = means.filter("NOT all_measure AND measure IS NOT NULL")
    total = means.filter("all_tier AND all_measure").select(scope.alias("at"), "mean")
    places = star.hospitals.groupingSets([[], [F.col("state")]], F.col("state")).agg(
        F.count_distinct("facility_id").alias("n"), F.grouping("state").cast("boolean").alias("all_state")).filter("all_state OR state IS NOT NULL")
    kpis = places.select(scope.alias("scope"), "n").join(total, F.col("scope") == F.col("at"), "left")
    parts = [breakdown_by_state(star),
             _rows(tiers, "volume_tiers", scope, F.col("tier"), F.lit(None), F.col("mean")),
             _rows(kpis, "kpis", F.col("scope"), F.lit(None), F.col("n"), F.col("mean")),
             _worst(_rows(measures, "worst_measures", scope, F.col("measure.measure_name"), F.col("n"), F.col("mean")), k),
             worst_hospitals_by_state(star, k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
