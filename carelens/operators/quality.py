"""Data-quality reports on cleaned visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from carelens import schema as S
from carelens.functions import scalars as X
from carelens.session import scratch_path

SUMMARY_COLUMNS = ["score", "denominator", "number_of_patients"]
QUARTILES = [0.25, 0.5, 0.75]


def category_counts(visits: DataFrame) -> DataFrame:
    """Frequency of each category, missing values as their own group."""
    return visits.groupBy("performance_category").agg(F.count(F.lit(1)).alias("frequency"))


BUCKETS_PER_OCTAVE = 4096


def value_counts(visits: DataFrame, columns: list[str] = SUMMARY_COLUMNS) -> DataFrame:
    """(variable, value, n): how often each column holds each value. Counts of several loads add up."""
    values = visits.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    return values.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def metric_summary(visits: DataFrame, columns: list[str] = SUMMARY_COLUMNS) -> DataFrame:
    """min, quartiles, median, mean, max and missing count per column.

    The values are counted in one scan and the counts written to the shared
    scratch folder; all else reads those counts (:func:`summary_of_counts`).
    """
    spark = visits.sparkSession
    counts, path = value_counts(visits, columns), scratch_path(spark, "value_counts")
    seen = Observation()
    counts.observe(seen, F.count_if(X.is_wide(F.col("value"))).alias("wide")).write.parquet(path)
    return summary_of_counts(spark.read.schema(counts.schema).parquet(path), plain=seen.get["wide"] == 0)


def summary_of_counts(counts: DataFrame, plain: bool = False) -> DataFrame:
    """The summary of a table of counts (variable, value, n), rows of one value adding up.

    Exact and spread out: the counts are summed into order-preserving buckets
    (a bounded number, logarithmic in the value), whose running sums name the
    bucket of each rank; only those few buckets are then ordered by value. A
    quartile between two rows is interpolated linearly. The mean is the exact
    sum of any doubles (:mod:`carelens.functions.exact`) over their number;
    ``plain`` says that none of them is wide.
    """
    x, n = F.col("value"), F.col("n")
    stats = counts.groupBy("variable").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum(X.plain_part(x) * n).alias("plain"),
        F.coalesce(F.sum(F.when(x.isNull(), n)), F.lit(0)).alias("missing"), F.sum(F.when(x.isNotNull(), n)).alias("rows"))
    bucket = F.floor(F.signum("value") * F.log2(F.abs("value") + 1) * BUCKETS_PER_OCTAVE)
    known = counts.filter(F.col("value").isNotNull()).withColumn("bucket", bucket)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = known.groupBy("variable", "bucket").agg(F.sum("n").alias("n")).withColumn(
        "before", before(Window.partitionBy("variable").orderBy("bucket")))
    # ranks from 0: the rows just below and above each quartile
    place = (F.col("rows") - 1) * F.col("q")
    ranks = known.groupBy("variable").agg(F.sum("n").alias("rows")).select(
        "variable", "rows", F.explode(F.array(*[F.lit(q) for q in QUARTILES])).alias("q")).select(
        "variable", "q", (place - F.floor(place)).alias("part"),
        F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    holds = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    wanted = ranks.join(buckets, "variable").filter(holds).select("variable", "q", "part", "rank", "bucket", F.col("before").alias("_b"))
    inside = known.join(wanted.select("variable", "bucket", "_b").distinct(), ["variable", "bucket"]).withColumn(
        "before", F.col("_b") + before(Window.partitionBy("variable", "bucket").orderBy("value")))
    found = inside.select("variable", "bucket", "value", "n", "before").join(
        wanted.drop("_b"), ["variable", "bucket"]).filter(holds)
    quartile = found.groupBy("variable", "q").agg(
        (F.min("value") + (F.max("value") - F.min("value")) * F.max("part")).alias("v"))
    pick = lambda i: F.max(F.when(F.col("q") == QUARTILES[i], F.col("v")))
    wide = quartile.groupBy("variable").agg(pick(0).alias("q1"), pick(1).alias("median"), pick(2).alias("q3"))
    total = F.col("plain").cast("double")
    if not plain:
        wide_bucket, digits = X.bucket_and_digits(x)
        buckets = (counts.filter(X.is_wide(x)).groupBy("variable", wide_bucket.alias("bucket"))
                   .agg(F.sum((digits * n).cast("decimal(38,0)")).alias("digits"))
                   .groupBy("variable").agg(F.collect_list(F.struct("bucket", "digits")).alias("buckets")))
        stats = stats.join(buckets, "variable", "left")
        total = F.when(F.col("buckets").isNull(), total).otherwise(X.exact_sum(X.with_plain_part(F.col("buckets"), F.col("plain"))))
    return stats.join(wide, "variable", "left").select(
        "variable", "min", "q1", "median", (total / F.col("rows")).alias("mean"), "q3", "max", "missing")


def breakdown_check(visits: DataFrame) -> DataFrame:
    """Category shares over the categorised rows only (C4).

    The total is a window over the handful of grouped rows, never over the
    visits. Shares round half to even on the exact ratio.
    """
    cat = F.col("performance_category")
    grouped = (visits.filter(cat.isNotNull() & (cat != ""))
               .groupBy("performance_category")
               .agg(F.count(F.lit(1)).alias("number_of_measures")))
    total = F.sum("number_of_measures").over(Window.partitionBy())
    return (grouped.withColumn("total_measures", total.cast("long"))
            .withColumn("percentage",
                        X.half_even_share_percent("number_of_measures", "total_measures", 1))
            .orderBy(F.desc("number_of_measures"), "performance_category"))


def rank_relabel(visits: DataFrame) -> DataFrame:
    """Relabel categories by their count rank into three tiers.

    With n groups and t = floor(n / 3): ranks 1..t, t+1..2t and the rest get
    the three labels in order. The label follows the rank, not the row's
    own category.
    """
    b = breakdown_check(visits)
    rank = F.row_number().over(Window.orderBy(F.desc("number_of_measures"), "performance_category"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = b.withColumn("_r", rank).withColumn("_t", F.floor(n / 3))
    label = (F.when(F.col("_r") <= F.col("_t"), S.RANK_LABELS[0])
             .when(F.col("_r") <= 2 * F.col("_t"), S.RANK_LABELS[1])
             .otherwise(S.RANK_LABELS[2]))
    return (ranked.withColumn("chart_category", label).drop("_r", "_t")
            .orderBy(F.desc("number_of_measures"), "performance_category"))
