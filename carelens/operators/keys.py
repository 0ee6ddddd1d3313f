"""Dense row ids in a declared order without one big partition.

``row_number().over(Window.orderBy(...))`` moves every row into a single
task. Here instead:

1. range-partition by the order key and sort within partitions (one
   shuffle, balanced by Spark's sampled boundaries; the key must be unique,
   so callers append a source-identity tie-break that also splits groups of
   identical rows);
2. write the partitions to the shared scratch folder, each row tagged
   with its partition index and position inside the partition. Writing cuts
   the lineage: later jobs never re-sample boundaries, and a lost executor
   cannot move a row to another position;
3. count rows per partition (a scan of one small column), turn the counts
   into running offsets (one row per partition, a bounded table), and
   add each row's position. The offsets are broadcast by name: their size is
   known to be a row per partition, while the planner's estimate of them grows
   with the rows counted and would have every row shuffled by its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.session import scratch_path


def dense_row_ids(df: DataFrame, order_cols: list[str], id_col: str = "temp_id",
                  start: int = 0, num_partitions: int | None = None,
                  path: str | None = None) -> DataFrame:
    """Return ``df`` plus ``id_col`` = start + 1, 2, ... in ``order_cols`` order."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "rowids")
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    tagged = ranged.sortWithinPartitions(*order_cols).select(
        "*",
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    tagged = tagged.withColumn(
        "_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
    tagged.write.mode("overwrite").parquet(path)

    stored = spark.read.schema(tagged.schema).parquet(path)
    counts = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
    out = stored.join(F.broadcast(offsets), "_pid").select(
        *[c for c in df.columns],
        (F.lit(start).cast("long") + F.col("_off") + F.col("_pos") + 1).alias(id_col),
    )
    return out
