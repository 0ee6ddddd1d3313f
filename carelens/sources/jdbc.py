"""Star tables over JDBC (S5, S6): read an existing relational star, or write one.

For users whose five tables already live in a relational database. Reads
are split: the fact and the junction by ``performance_id`` ranges (the
bounds come from one ``MIN``/``MAX`` query), the dimensions in one task
each, since they are small. A JDBC driver for the database must be on the
classpath; nothing here starts or needs a database of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelens import schema as S
from carelens.operators.star import Star
from carelens.sources.tables import TABLES, cast_table

SPLIT_TABLES = {"performance_data": "performance_id", "performance_footnotes": "performance_id"}


def read_plan(table: str, lower: int | None, upper: int | None, partitions: int) -> dict:
    """Reader options for one table: a range split for the id-keyed tables."""
    column = SPLIT_TABLES.get(table)
    if column is None or lower is None or upper is None or partitions <= 1:
        return {"dbtable": table}
    return {"dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
            "upperBound": str(upper + 1), "numPartitions": str(partitions)}


def load_star_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
                   partitions: int = 64, check: bool = True) -> Star:
    """Read the five tables; ``properties`` holds user, password, driver."""
    def reader(options: dict) -> DataFrame:
        r = spark.read.format("jdbc").option("url", url)
        for k, v in {**properties, **options}.items():
            r = r.option(k, v)
        return r.load()

    bounds = reader({"query": "SELECT MIN(performance_id) AS lo, MAX(performance_id) AS hi "
                              "FROM performance_data"}).first()
    lo, hi = (bounds[0], bounds[1]) if bounds else (None, None)
    tables = {n: reader(read_plan(n, lo, hi, partitions)) for n in TABLES}
    return Star(**{n: cast_table(df, S.STAR_DDL[n], n) if check else df for n, df in tables.items()})


def save_star_jdbc(star: Star, url: str, properties: dict[str, str], mode: str = "append",
                   batch_size: int = 10_000) -> None:
    """Write the five tables (``append`` as the load does, or ``overwrite``, which
    empties the existing tables and keeps their keys and column types).

    Each task writes its partition in batches; partitions write in parallel.
    """
    for name, df in star.tables().items():
        w = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", name) \
            .option("batchsize", str(batch_size)).option("truncate", True)
        for k, v in properties.items():
            w = w.option(k, v)
        w.save()
