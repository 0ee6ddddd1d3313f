"""Line deduplication over levelled sorted runs of line hashes (operator 6).

A line's key is the line without white space at its ends, A-Z lower-cased,
held as a 128-bit hash. A *run* is a Parquet folder of (key, documents that
have it, whether the key entered here), hash-partitioned and sorted by key.
Each batch of documents is merge-anti-joined with the runs: its run at level 0
holds the new keys as entering, and the known ones as raises of their counts.
When ``fanout`` runs share a level they are merged, counts added, into one of
the next level. So n batches leave at most (fanout - 1) * log(n) runs, and each
key is rewritten log(n) times. A key may become frequent in the last batch, so
lines are dropped when all batches are in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import scratch_path

from . import text as T
from .bitmap import id_bitmap, marked_rows
from .tables import remove, store

KEY = ["h1", "h2"]


def lines(off: np.ndarray, raw: np.ndarray):
    """Row, first byte, end byte, and both key hashes of every line; lines
    without a key have hash 0, 0. A row of no bytes is one empty line."""
    cut = np.flatnonzero(raw == 10)
    n = len(off) - 1
    start = np.sort(np.concatenate((off[:-1], cut + 1)), kind="stable")
    end = np.sort(np.concatenate((off[1:], cut)), kind="stable")
    row = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(cut, off)))
    word = ~T.SPACE[raw]
    at = np.flatnonzero(word)
    first = np.searchsorted(at, start)
    last = np.searchsorted(at, end) - 1
    keyed = first <= last
    h1, h2 = np.zeros(len(start), T.U64), np.zeros(len(start), T.U64)
    a, b = at[first[keyed]], at[last[keyed]] + 1
    h1[keyed] = T.span_hashes(raw, a, b) | T.U64(1)
    h2[keyed] = T.span_hashes(raw, a, b, which=1)
    return row, start, end, h1, h2


def _key_rows(batches):
    """The distinct line keys of each row, with the row's text key."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        for a, b, o, r in T.chunks(*T.buffers(batch.column("text"))):
            row, _, _, h1, h2 = lines(o, r)
            keep = np.flatnonzero(h1)
            order = keep[np.lexsort((h2[keep], h1[keep], row[keep]))]
            x = np.stack([row[order].astype(T.U64), h1[order], h2[order]])
            order = order[np.concatenate(([True], (x[:, 1:] != x[:, :-1]).any(axis=0)))] if len(order) else order
            part = batch.slice(a, b - a)
            take = pa.array(row[order])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(take) for c in names), pa.array(h1[order].view(np.int64)), pa.array(h2[order].view(np.int64))],
                [*names, *KEY])


def line_keys(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, h1, h2: one row per row of ``docs`` and distinct line key."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, "text").mapInArrow(
        _key_rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "h1 long, h2 long"]))


class LineRuns:
    """The levelled runs; ``levels`` holds the folders of each level's runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long, first boolean").parquet(*paths)

    def _write(self, counts: DataFrame) -> str:
        path = scratch_path(self.spark, "line_run")
        counts.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def counts(self) -> DataFrame:
        """Documents per key over all runs."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self._read(self.runs()).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def marked(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``first``: whether the key is in no run yet. One merge join for
        all runs: each key is ``first`` in one of them, and only those rows are read."""
        if not self.runs():
            return keys.withColumn("first", F.lit(True))
        known = self._read(self.runs()).filter("first").select(*KEY, F.lit(True).alias("_known"))
        return keys.join(known.hint("merge"), KEY, "left").withColumn("first", F.isnull("_known")).drop("_known")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in no run yet."""
        return self.marked(keys).filter("first").drop("first")

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join a batch's ``(h1, h2, n)`` (a key once) with the runs and add its
        own run: new keys enter, known ones raise their counts. Then compact full levels."""
        self._put(0, self._write(self.marked(counts)))

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._read(full).groupBy(*KEY).agg(F.sum("n").alias("n"), F.bool_or("first").alias("first")))
            remove(self.spark, *full)
            self._put(level + 1, merged)


def _dropper(with_text: bool):
    def run(batches):
        return _drop_lines(batches, with_text)
    return run


def _drop_lines(batches, with_text):
    for batch in batches:
        blocked = batch.column("blocked") if "blocked" in batch.schema.names else None
        for a, b, o, r in T.chunks(*T.buffers(batch.column("text"))):
            row, start, end, h1, h2 = lines(o, r)
            cut = np.searchsorted(row, np.arange(b - a + 1))
            body, n_dropped, sha, kept = r.tobytes(), [], [], []
            for i in range(b - a):
                s = slice(cut[i], cut[i + 1])
                drop = np.zeros(cut[i + 1] - cut[i], dtype=bool)
                if blocked is not None and blocked[a + i].is_valid:
                    flat = blocked[a + i].values.flatten()  # pairs of hashes, held as structs
                    k1, k2 = (x.to_numpy().view(T.U64) for x in flat)
                    order = np.argsort(k1, kind="stable")
                    at = np.searchsorted(k1[order], h1[s])
                    hit = at < len(order)
                    hit[hit] = k1[order][at[hit]] == h1[s][hit]
                    known = set(zip(k1.tolist(), k2.tolist()))
                    for j in np.flatnonzero(hit & (h1[s] > 0)):
                        drop[j] = (int(h1[s][j]), int(h2[s][j])) in known
                if drop.any():
                    text = b"\n".join(body[x:y] for x, y, d in zip(start[s], end[s], drop) if not d)
                else:
                    text = body[o[i]:o[i + 1]]
                n_dropped.append(int(drop.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text if with_text else None)
            out = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(cut)), pa.array(n_dropped, pa.int64()),
                   pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())][:5 if with_text else 4]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][:len(out)])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2,
                        with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text if asked for), one row per row of ``docs (doc_id, text)``.

    A key found in at least ``min_docs`` rows loses all its lines everywhere;
    lines of white space alone have no key and stay. The rows are taken in
    ``batches`` batches (by a hash of the text), each adding a run.

    Null and empty texts have one empty line, which stays. Each row is a
    document, whatever its doc_id (null or repeated). Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("tk", F.xxhash64("text"))
    batch = F.pmod(F.xxhash64("tk"), F.lit(batches)).cast("int").alias("batch")
    first, path = store(line_keys(docs.select(batch, "text"), ["batch"]).groupBy("batch", *KEY).agg(
        F.count("*").alias("n")), "line_batches")
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(first.filter(F.col("batch") == k).select(*KEY, "n").repartition(*KEY))
    remove(spark, path)
    frequent, _ = store(runs.counts().filter(F.col("n") >= min_docs).select(*KEY), "frequent_lines")
    # the frequent keys of each text: any text with the key may carry it, so equal hashes of texts do no harm
    hits = line_keys(docs.select("tk", "text"), ["tk"]).distinct().join(frequent, KEY, "left_semi")
    sets, _ = store(hits.groupBy("tk").agg(F.collect_set(F.struct(*KEY)).alias("blocked")), "blocked_lines")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + (
        ", kept_text string" if with_text else "")
    marks = id_bitmap(sets, "tk")
    touched = marked_rows(docs, marks, "tk", True).join(sets.hint("merge"), "tk", "left").select("doc_id", "text", "blocked")
    whole = marked_rows(docs, marks, "tk", False).select("doc_id", "text")
    return touched.mapInArrow(_dropper(with_text), schema).union(whole.mapInArrow(_dropper(with_text), schema))
