"""What the load moves and writes stays in proportion to its rows, whatever the planner's size estimates say."""

import pytest
from pyspark.sql import functions as F

from carelens.operators.dedup import first_row_per_key
from carelens.operators.keys import dense_row_ids
from tests.plan_report import plan_text


@pytest.fixture
def no_broadcast(spark):
    """Estimates as of large tables: no side is broadcast for being small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbered_rows_are_not_shuffled_by_their_partition(spark, no_broadcast):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    out = dense_row_ids(rows, ["k"], num_partitions=4)
    assert "SortMergeJoin" not in plan_text(out) and "BroadcastHashJoin" in plan_text(out)
    assert all(r.temp_id == r.k + 1 for r in out.collect())


def test_first_rows_are_picked_among_different_rows(spark, no_broadcast):
    rows = spark.range(0, 10_000, 1, 4).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("k"),
                                               F.concat(F.lit("name "), F.col("id") % 2).alias("name"), (10_000 - F.col("id")).alias("n"))
    out = first_row_per_key(rows, "k", ["k", "name"], "n")
    # what is shuffled comes out of an aggregation inside the map tasks: no row goes as it is
    nodes = [x.split("+- ")[1].split()[0] for x in plan_text(out).split("\n\n")[0].splitlines() if "+- " in x]
    nodes = [n for n in nodes if n not in ("Filter", "Project")]
    assert "Exchange" in nodes and all(b == "HashAggregate" for a, b in zip(nodes, nodes[1:]) if a == "Exchange")
    assert {r.k: r.name for r in out.collect()} == {(str(i % 7) if i % 7 else None): f"name {i % 2}" for i in range(9993, 10_000)}
