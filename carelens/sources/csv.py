"""Text extracts: read the raw CSV (S1-S3), write the cleaned CSV."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from csv import reader
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens import schema as S
from carelens.session import scratch_path


def clean_names(names: list[str]) -> list[str]:
    """Header names -> unique snake_case names (S3).

    ``%`` and ``#`` are spelled out, camelCase and acronyms are split, every
    run of other characters becomes one underscore; names are lower-cased,
    trimmed of underscores, and a repeat takes the first free number
    (``x``, ``x_2``, ...).
    """
    out: list[str] = []
    for n in names:
        s = n.replace("%", " percent ").replace("#", " number ")
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
        s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
        s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower() or "x"
        if s[0].isdigit():
            s = "x" + s
        k, name = 2, s
        while name in out:
            k, name = k + 1, f"{s}_{k}"
        out.append(name)
    return out


FILE, BLOCK, POSITION = "_file", "_block", "_position"


def with_file_place(df: DataFrame) -> DataFrame:
    """Rows of a file scan with their file, split start and a number that grows
    within the split (taken right at the scan)."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
                     F.monotonically_increasing_id().alias(POSITION))


def placed_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write rows that carry :func:`with_file_place` once, to the shared scratch
    folder: the rows as stored, and the split manifest (file, split, rows, first
    position, rows before the split) made from them.

    The files are scanned by this one job, so it does not matter how another
    scan of them would be cut: a row's place is stored with the row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "placed")
    df.write.parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    splits = rows.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_rows"), F.min(POSITION).alias("_first"))
    before = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    manifest = splits.select("*", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    manifest.write.parquet(f"{path}/splits")
    return rows, spark.read.schema(manifest.schema).parquet(f"{path}/splits")


def file_order_ids(df: DataFrame, id_col: str, start: int = 0) -> DataFrame:
    """Dense ids start + 1, 2, ... in the order of file path, split and row, for
    rows that carry :func:`with_file_place`; those columns are dropped.

    No row is shuffled to be ordered: a row's id is its split's offset in the
    stored manifest (one row per split) plus its place in the split.
    """
    rows, manifest = placed_rows(df)
    return rows.join(manifest, [FILE, BLOCK]).withColumn(
        id_col, F.lit(start).cast("long") + F.col("_before") + F.col(POSITION) - F.col("_first") + 1).drop(
        FILE, BLOCK, POSITION, "_rows", "_first", "_before")


def first_record(spark: SparkSession, file: str) -> str | None:
    """The first line of a text file (compressed ones too), with the lines that a
    quoted line break adds; None if the file is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
        codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
    try:
        record = line = reader.readLine()
        while line is not None and record.count('"') % 2:
            line = reader.readLine()
            record += "\n" + (line or "")
        return record
    finally:
        reader.close()


def header_manifest(spark: SparkSession, path: str | list[str], threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` (file, folder, glob or list) by their normalised header:
    column names in file order -> files. One small read per file; empty files have no rows and are left out."""
    uris = spark.read.text(path).inputFiles()
    files = sorted(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(u)).toString() for u in uris)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        records = list(pool.map(lambda f: first_record(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, record in zip(files, records):
        if record is not None:
            names = next(reader([record.removeprefix("\ufeff")], strict=False), [])
            groups.setdefault(tuple(clean_names(names)), []).append(file)
    return groups


def read_raw_visits(spark: SparkSession, path: str | list[str], multiline: bool = True, optional: tuple[str, ...] = ()) -> DataFrame:
    """Read raw extracts: header rows, every column as text.

    Each file is read by its own header: columns may stand in another order in
    another file, and files may have further columns, which are not read. A
    file that lacks a column is an error that names both, unless the column is
    ``optional``: then it reads as empty text.

    No schema inference: it would turn ids such as ``01014F`` or ZIPs such as
    ``00501`` into numbers. Blank fields read as empty text. Each row gets
    ``_src``, its number in file order over all files (by path); the rows are
    scanned and stored once (:func:`placed_rows`).

    Quoted fields may hold line breaks, so one file is read by one task: give
    a large extract as many files. ``multiline=False`` splits large files,
    for extracts without such fields.
    """
    groups = header_manifest(spark, path)
    lacking = [f"{files[0]} lacks {missing}" for names, files in groups.items()
               if (missing := [c for c in S.RAW_COLUMNS if c not in names and c not in optional])]
    if lacking:
        raise ValueError(f"raw extract lacks columns: {'; '.join(lacking)}")
    parts = [spark.createDataFrame([], S.RAW_SCHEMA).select("*", F.lit("").alias(FILE), F.lit(0).cast("long").alias(BLOCK),
                                                            F.lit(0).cast("long").alias(POSITION))]
    for names, files in groups.items():
        df = (spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True)
              .option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multiline)
              .csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]))
        df = df.withColumns({c: F.lit("") for c in S.RAW_COLUMNS if c not in names})
        parts.append(with_file_place(df).select(*blank_as_text(S.RAW_COLUMNS), FILE, BLOCK, POSITION))
    return file_order_ids(reduce(DataFrame.unionByName, parts[1:] or parts), S.SOURCE_ID)


def blank_as_text(columns: list[str]) -> list:
    """Raw text columns with NULL (a blank field) read as empty text."""
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read back a CSV written by :func:`write_csv` with every column as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("nullValue", "").option("multiLine", True).csv(path))


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite", compression: str = "none") -> str:
    """Write with a header; NULL and empty text both as empty fields, other text
    unchanged: outer blanks, quotes and line breaks included (S4)."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("nullValue", "").option("emptyValue", "")
       .option("quoteAll", quote_all).option("compression", compression).csv(path))
    return path
