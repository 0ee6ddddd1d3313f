"""Session construction and the shared scratch location.

On a cluster the session is created by the platform and already names a
shared checkpoint folder (``spark.checkpoint.dir``); this module only reads
it. A folder is set here only when none is configured, under the warehouse
directory, and only where that is shared by all executors: a local session,
or a warehouse on a shared file system. Otherwise an error asks for one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app_name: str = "carelens",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings these jobs rely on.

    * AQE on: partitions coalesce at runtime, skewed join partitions split,
      and shuffle joins turn into broadcast joins when a side proves small.
    * UTC session time zone, so date text is stable.
    * No web UI.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = re.fullmatch(r"local(\[.*\])?", sc.master)
        if not local and re.match(r"(file:|/)", warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: "
                               f"{warehouse} is on each machine's own disk")
        configured = warehouse.rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint location."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/carelens/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate tables that nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
