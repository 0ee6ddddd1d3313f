"""First row per key in row order (A14): ``distinct(key, .keep_all = TRUE)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_row_per_key(df: DataFrame, key: str, columns: list[str], order_col: str) -> DataFrame:
    """Keep, for each ``key``, the ``columns`` of the row with the smallest ``order_col``
    (which must be unique).

    Hash aggregations find the smallest ``order_col`` per key and that of each
    different row of ``key`` and ``columns`` (rows with a large share of the
    table are reduced inside each map task); the former pick their rows among
    the latter, so only different rows are shuffled. ``dropDuplicates`` would
    keep an arbitrary row instead.
    """
    different = df.groupBy(*dict.fromkeys([key, *columns])).agg(F.min(order_col).alias("_at"))
    firsts = df.groupBy(key).agg(F.min(order_col).alias("_first")).select("_first")
    return different.join(firsts, F.col("_at") == F.col("_first"), "left_semi").select(*columns)
