"""Incremental load of new extracts into a stored star (S5 append, C7 + J6).

New CSV extracts dropped into a landing folder are picked up by a Structured
Streaming file source; each micro-batch goes through the same append path as
the command line (:mod:`carelens.plans.append`), rows numbered in file order.

A landing folder has its own progress folder inside the star, so a later call
goes on where the last one ended, and its own load ids (folder and batch), so
no folder's batches replace another's. A batch that is run again after a
failure replaces its own rows, and is seen in all tables at once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from carelens.plans.append import append_star
from carelens.plans.load import numbered_visits
from carelens.sources.csv import read_raw_visits


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def source_key(landing_dir: str) -> str:
    return hashlib.sha256(landing_dir.rstrip("/").encode()).hexdigest()[:16]


def load_batch(spark: SparkSession, files: list[str], star_path: str, load_id: str, multiline: bool = True) -> dict[str, int]:
    """Read the extracts ``files``, each by its own header, and add them to the star under ``load_id``."""
    raw = read_raw_visits(spark, files, multiline)
    return append_star(spark, star_path, lambda start: numbered_visits(raw, [], start=start), load_id)


def start_incremental_load(spark: SparkSession, landing_dir: str, star_path: str,
                           checkpoint_location: str | None = None,
                           available_now: bool = True,
                           processing_time: str | None = None,
                           multiline: bool = True) -> StreamingQuery:
    """Stream CSV extracts from ``landing_dir`` into the star at ``star_path``.

    The stream is one of files; the rows of a batch's files are read as
    :func:`read_raw_visits` reads them, so columns may stand in any order.
    Quoted fields may hold line breaks. ``available_now``
    processes what is there and stops; otherwise the query polls every
    ``processing_time``. Progress is kept at ``checkpoint_location``, by
    default in the star's folder, one for each landing folder.
    """
    key = source_key(landing_dir)
    ck = checkpoint_location or f"{star_path.rstrip('/')}/_ingest/{key}"
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(landing_dir).select("path")  # the content is not read here

    def each(batch: DataFrame, batch_id: int) -> None:
        files = [r.path for r in batch.collect()]
        if files:
            load_batch(spark, files, star_path, f"{key}-{batch_id}", multiline)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(
        processingTime=processing_time or "1 minute")
    return w.start()


__all__ = ["load_batch", "start_incremental_load", "source_key"]
