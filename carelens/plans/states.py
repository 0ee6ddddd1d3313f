"""Reports kept up to date by the loads: partial results that merge.

Each load writes, beside its rows and committed with them, one row per facility
of its readmission facts: how many scores, their least, largest and exact sum
(:mod:`carelens.functions.exact`), and the volume. A facility's state and name
may only become known with a later load, so the partial results are kept by
facility and joined to ``hospitals`` when a report is asked for; rows of several
loads merge by sum, least and largest, facilities by their distinct ids. The
fact table is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.operators.star import Star

DDL = ("facility_id string, n bigint, low double, high double, volume double, plain decimal(38,4), "
       "buckets array<struct<bucket:int,digits:decimal(38,0)>>")


def facility_state(facts: DataFrame) -> DataFrame:
    """One row per facility of the readmission facts."""
    x = F.col("score")
    f = facts.filter(x.isNotNull() & X.is_readmission("measure_id")).select("facility_id", "score", "denominator")
    main = f.groupBy("facility_id").agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
                                        F.sum("denominator").alias("volume"), F.sum(X.plain_part(x)).cast("decimal(38,4)").alias("plain"))
    bucket, digits = X.bucket_and_digits(x)
    wide = (f.filter(X.is_wide(x)).groupBy(F.col("facility_id").alias("_f"), bucket.alias("bucket"))
            .agg(F.sum(digits).cast("decimal(38,0)").alias("digits"))
            .groupBy("_f").agg(F.collect_list(F.struct("bucket", "digits")).alias("buckets")))
    return main.join(wide, F.col("facility_id").eqNullSafe(F.col("_f")), "left").drop("_f")


def merged(star: Star, keys: list[str]) -> DataFrame:
    """``keys`` (of the facility), number_of_hospitals, volume, low, high and the rounded mean."""
    if star.facility_state is None:
        raise ValueError("this star was stored without the loads' partial results")
    placed = star.facility_state.join(star.hospitals.select("facility_id", *[k for k in keys if k != "all"]), "facility_id")
    if "all" in keys:
        placed = placed.withColumn("all", F.coalesce(F.col("n") * 0, F.lit(0)))  # not a literal: the join on it stays an equi-join
    out = placed.groupBy(*keys).agg(
        F.count_distinct("facility_id").alias("number_of_hospitals"), F.sum("volume").alias("volume"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("plain").cast("decimal(38,4)").alias("plain"), F.sum("n").alias("n"))
    mean = F.round(F.col("plain") / F.col("n").cast("decimal(20,0)"), 2).cast("double")
    if not star.plain_scores:
        wide = (placed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode("buckets").alias("b"))
                .groupBy(*[f"_{k}" for k in keys], F.col("b.bucket").alias("bucket")).agg(F.sum("b.digits").cast("decimal(38,0)").alias("digits"))
                .groupBy(*[f"_{k}" for k in keys]).agg(F.collect_list(F.struct("bucket", "digits")).alias("buckets")))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(wide, same, "left")
        mean = F.when(F.col("buckets").isNull(), mean).otherwise(
            X.rounded_mean(X.with_plain_part(F.col("buckets"), F.col("plain")), F.col("n")))
    return out.select(*keys, "number_of_hospitals", "volume", "low", "high", mean.alias("mean"))


def state_scores_merged(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """N7 from the loads' partial results."""
    return (merged(star, ["state"]).filter(F.col("number_of_hospitals") > min_hospitals)
            .select("state", "number_of_hospitals", F.col("mean").alias("average_state_score"))
            .orderBy(F.desc("average_state_score"), "state"))


def state_map_merged(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """N8 from the loads' partial results."""
    return state_scores_merged(star, min_hospitals).select("state", "average_state_score")


def state_details_merged(star: Star, min_hospitals: int = S.STATE_MIN_HOSPITALS) -> DataFrame:
    """N9 from the loads' partial results."""
    return (merged(star, ["state"]).filter(F.col("number_of_hospitals") > min_hospitals)
            .select("state", "number_of_hospitals", F.col("volume").alias("total_patient_volume"), F.col("low").alias("min_score"),
                    F.col("high").alias("max_score"), F.col("mean").alias("average_score"))
            .orderBy(F.desc("average_score"), "state"))


def kpis_merged(star: Star, state: str | None = None) -> DataFrame:
    """N15 from the loads' partial results."""
    h = star.hospitals.filter(F.col("state") == state) if state else star.hospitals
    mean = merged(star.replace(hospitals=h), ["all"]).select("mean").scalar()
    return h.agg(F.count_distinct("facility_id").alias("total_hospitals")).select(
        "total_hospitals", mean.alias("average_readmission_score"))
