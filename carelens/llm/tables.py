"""Intermediate tables in the shared folder of the session.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (never on a
machine's own disk) and reading it back with a known schema, so a lost
executor costs the tasks it ran and no earlier stage.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import scratch_path

PACKAGE = Path(__file__).resolve().parent.parent
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # what Spark hands to a Python worker at a time (or one row)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application):
    a zip of it in the shared folder, handed to ``addPyFile``.

    Arrow batches of the session are bounded in bytes, unless it has a bound: by
    default one has 10,000 rows however long their texts, in the JVM and in the worker.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent).as_posix())
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "code") + "/carelens.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(body.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def store(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` to a fresh shared folder (``options``: of the Parquet writer); return it as read back, and the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    return store(df, name, **options)[0]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders that no later result reads."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def crc32_mod(col, n: int):
    """crc32 of the id's decimal text modulo ``n``: the folds of the queries."""
    return F.crc32(col.cast("string").cast("binary")) % n
