"""A fixed-size bitmap of ids: drops most rows that cannot join before the shuffle.

The bitmap has ``BITS`` bits whatever the data, so its broadcast is bounded.
It only ever lets too much through: beyond about ``BITS`` ids it passes
everything and the join behind it does all of the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BITS = 1 << 23


def _bit(col) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(BITS))


def id_bitmap(ids: DataFrame, col: str):
    """Broadcast bitmap of ``ids[col]``; at most BITS / 32 partial words reach the driver."""
    rows = (ids.select(_bit(F.col(col)).alias("b"))
            .groupBy(F.shiftright("b", 5).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("v"))
            .toArrow())
    words = np.zeros(BITS // 32, dtype="<u4")
    words[rows["w"].to_numpy()] = rows["v"].to_numpy().astype("<u4")
    marked = np.unpackbits(words.view(np.uint8), bitorder="little")
    return ids.sparkSession.sparkContext.broadcast(np.packbits(marked))


def marked_rows(df: DataFrame, bitmap, col: str, marked: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``col`` may be one of the ids, or (``marked`` false) cannot be."""
    names = df.columns

    @T.giving_back
    def run(batches):
        bits = np.unpackbits(bitmap.value).view(bool) == marked
        for batch in batches:
            yield batch.select(names).filter(pa.array(bits[batch.column("_bit").to_numpy()]))

    return df.withColumn("_bit", _bit(F.col(col))).mapInArrow(run, df.schema)
