"""Star tables on storage.

Parquet folders by default, or catalog tables. Every folder is partitioned by
the load that wrote its rows, the fact also by ``measure_family`` (``READM``, ``EDAC``, ``OTHER``), so the readmission filter of the reports prunes whole
folders; these are derived columns and the reports never return them. Inside a
load and family the facts lie by facility, so the minima and maxima that
Parquet keeps per row group and page leave little to read for one facility.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens import schema as S
from carelens.functions.exact import is_wide
from carelens.operators.star import Star
from carelens.plans.states import DDL as STATE_DDL, facility_state
from carelens.session import folder_names, path_exists, remove_path
from carelens.sources.commits import LoadLog

FAMILY_COLUMN = "measure_family"
LOAD_COLUMN = "load_id"
FIRST_LOAD = "first"
OTHER_FAMILY = "OTHER"
STATE_TABLE = "readmission_by_facility"
#: the fact's order inside a load; the row id spreads a facility with many facts over several files
CLUSTERED = [FAMILY_COLUMN, "facility_id", "performance_id"]
TABLES = ["hospitals", "measures", "footnotes", "performance_data", "performance_footnotes"]


def measure_family(measure_id) -> Column:
    m = F.col(measure_id) if isinstance(measure_id, str) else measure_id
    out = None
    for p in S.READMISSION_PREFIXES:
        out = F.when(m.startswith(p), F.lit(p)) if out is None else out.when(m.startswith(p), F.lit(p))
    return out.otherwise(F.lit(OTHER_FAMILY))


def write_table(name: str, df: DataFrame, path: str, part: str, by_facility: bool = False) -> dict:
    """Write one table's rows into the partition ``part``; returns rows (and the
    largest fact id), counted as they are written. Facts that come ``by_facility``
    are sorted where they are; others are first shuffled to lie so."""
    seen = Observation()
    counted = [F.count(F.lit(1)).alias("rows")]
    if name == "performance_data":
        counted += [F.max("performance_id").alias("last_id"), F.count_if(is_wide(F.col("score"))).alias("wide_scores")]
        # counted after the shuffle: the job that samples the ranges runs what is before it once more
        placed = df.withColumn(FAMILY_COLUMN, measure_family("measure_id"))
        placed = placed if by_facility else placed.repartitionByRange(*CLUSTERED)
        writer = placed.observe(seen, *counted).sortWithinPartitions(*CLUSTERED).write.partitionBy(FAMILY_COLUMN)
    else:
        writer = df.observe(seen, *counted).write
    # a folder of its own: jobs of two loads must not share an output folder
    writer.mode("overwrite").parquet(f"{path}/{LOAD_COLUMN}={part}")
    return seen.get


def write_part(star: Star, path: str, part: str, parallel: int = 5, write: Callable = write_table) -> tuple[dict[str, int], dict]:
    """Write the five tables' rows as partition ``part``: rows per table (S10), and what was counted of the fact.

    The writes (the tables, and the partial results of the reports) are
    independent jobs over the same stored input and are submitted together (``parallel`` threads), so the stages of one fill the
    slots the small final stages of another leave idle.
    """
    def one(item):
        there = {"by_facility": True} if star.by_facility and item[0] == "performance_data" else {}
        return item[0], write(item[0], item[1], f"{path.rstrip('/')}/{item[0]}", part, **there)

    tables = star.tables() | {STATE_TABLE: facility_state(star.performance_data)}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        seen = dict(pool.map(one, tables.items()))
    return {n: seen[n]["rows"] for n in TABLES}, seen["performance_data"]


def new_part(load_id: str) -> str:
    """A partition value of its own for each try of a load."""
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', load_id)}-{uuid.uuid4().hex[:12]}"


def stored_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """The partitions a star without a commit log holds, each as a load."""
    found = set()
    for name in TABLES:
        found |= {n.split("=", 1)[1] for n in folder_names(spark, f"{path.rstrip('/')}/{name}") if n.startswith(f"{LOAD_COLUMN}=")}
    return {p: p for p in found}


def save_star(star: Star, path: str, mode: str = "overwrite", load_id: str = FIRST_LOAD,
              parallel: int = 5, write: Callable = write_table) -> dict[str, int]:
    """Write the five tables under ``path``; returns the rows of this write per table.

    Every table is partitioned by ``load_id`` (a value per load and try).
    ``overwrite`` replaces the star; ``append`` writes one load: it adds the
    rows, or replaces those of an earlier one with the same ``load_id``, and
    leaves all others alone. Either becomes visible in all tables at once, when
    it is committed (:mod:`carelens.sources.commits`); a write that fails
    changes nothing a reader sees. An empty input appends nothing (S12).
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is overwrite or append, not {mode}")
    spark = star.hospitals.sparkSession
    log, part = LoadLog(spark, path), new_part(load_id)
    if mode == "append" and not log.exists() and star_exists(spark, path):
        log.commit(0, stored_parts(spark, path), 0)
    rows, fact = write_part(star, path, part, parallel, write)
    while True:  # again if another load came in: this one's rows do not depend on it
        before = log.state()
        if log.commit(before.version, {load_id: part}, fact["last_id"] or 0, mode == "overwrite", rows, fact):
            break
    if mode == "overwrite":
        remove_path(spark, *[f"{path.rstrip('/')}/{n}/{LOAD_COLUMN}={p}" for n in [*TABLES, STATE_TABLE] for p in before.parts.values()])
    return rows


def remove_unseen(spark: SparkSession, path: str) -> list[str]:
    """Delete the partitions that no reader sees (of failed or replaced loads).
    Not while another load is running: its partitions are not visible yet."""
    seen, gone = set(LoadLog(spark, path).state().parts.values()), []
    for name in [*TABLES, STATE_TABLE]:
        base = f"{path.rstrip('/')}/{name}"
        gone += [f"{base}/{n}" for n in folder_names(spark, base) if n.startswith(f"{LOAD_COLUMN}=") and n.split("=", 1)[1] not in seen]
    remove_path(spark, *gone)
    return gone


def star_exists(spark: SparkSession, path: str) -> bool:
    """Whether a star is stored at ``path``; an error if only some of its tables are."""
    there = [n for n in TABLES if path_exists(spark, f"{path.rstrip('/')}/{n}")]
    if there and len(there) < len(TABLES):
        raise ValueError(f"{path} holds only {there}: not a star")
    return bool(there)


def check_schema(df: DataFrame, ddl: str, name: str = "table") -> DataFrame:
    """Structure check (S11): the declared columns with their types must be
    present; extra columns (such as partition columns) are allowed."""
    want = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f"{f.name} {f.dataType.simpleString()} (found "
           f"{have[f.name].simpleString() if f.name in have else 'nothing'})"
           for f in want.fields if have.get(f.name) != f.dataType]
    if bad:
        raise ValueError(f"{name}: unexpected structure: {', '.join(bad)}")
    return df


def cast_table(df: DataFrame, ddl: str, name: str = "table") -> DataFrame:
    """The declared columns in their declared types (a database may hold an id as
    INT or a score as DECIMAL); an error if a column is missing."""
    want = T.StructType.fromDDL(ddl)
    missing = [f.name for f in want.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def load_star(spark: SparkSession, path: str, check: bool = True, without_load: str | None = None) -> Star:
    """Read the five tables back (S6, S7). The fact keeps ``measure_family``.

    The columns that are there are checked against the declared ones (S11). A
    table without rows reads empty. Of a star with a commit log only committed
    loads are read, as a filter on the partitions. ``without_load`` leaves one out.
    """
    base = path.rstrip("/")
    log, t = LoadLog(spark, base), {}
    state = log.state()
    parts = [p for k, p in state.parts.items() if k != without_load] if log.exists() else None
    plain = bool(parts) and all(state.facts[k].get("wide_scores") == 0 for k in state.parts)
    for name in TABLES:
        extra = f", {LOAD_COLUMN} string" + (f", {FAMILY_COLUMN} string" if name == "performance_data" else "")
        df = spark.read.schema(S.STAR_DDL[name] + extra).parquet(f"{base}/{name}")
        if check and not df.isEmpty():
            check_schema(spark.read.parquet(f"{base}/{name}"), S.STAR_DDL[name], name)
        if parts is not None:
            df = df.filter(F.col(LOAD_COLUMN).isin(parts))
        elif without_load is not None:
            df = df.filter(F.col(LOAD_COLUMN) != without_load)
        t[name] = df.drop(LOAD_COLUMN)
    if log.exists() and path_exists(spark, f"{base}/{STATE_TABLE}"):
        state_rows = spark.read.schema(f"{STATE_DDL}, {LOAD_COLUMN} string").parquet(f"{base}/{STATE_TABLE}")
        t["facility_state"] = state_rows.filter(F.col(LOAD_COLUMN).isin(parts)).drop(LOAD_COLUMN)
    return Star(**t, plain_scores=plain)


def save_star_tables(star: Star, database: str | None = None, mode: str = "overwrite",
                     prefix: str = "") -> None:
    """Write the five tables to the session catalog (``saveAsTable``)."""
    for name, df in star.tables().items():
        full = f"{database}.{prefix}{name}" if database else f"{prefix}{name}"
        w = df
        writer = None
        if name == "performance_data":
            w = df.withColumn(FAMILY_COLUMN, measure_family("measure_id"))
            writer = w.write.mode(mode).partitionBy(FAMILY_COLUMN)
        else:
            writer = w.write.mode(mode)
        writer.saveAsTable(full)


def load_star_tables(spark: SparkSession, database: str | None = None, prefix: str = "") -> Star:
    def t(n):
        return spark.table(f"{database}.{prefix}{n}" if database else f"{prefix}{n}")
    return Star(**{n: t(n) for n in TABLES})


def register_views(star: Star, prefix: str = "") -> list[str]:
    """Expose the five tables as temporary views for ``spark.sql``.

    Queries written against the star schema run unchanged on the views;
    Catalyst plans them like the DataFrame reports (pushed filters, pruned
    columns, the readmission filter on ``measure_family`` if added).
    """
    names = []
    for name, df in star.tables().items():
        df.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names
