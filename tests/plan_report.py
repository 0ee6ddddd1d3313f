"""Summarise the physical plan of every registered query (PLANS.md).

For each query: scans (with pushed / partition filters), shuffles, join
strategies, sorts and Python evaluation nodes, read from
``explain("formatted")``. Run: ``python tests/plan_report.py [sf_dir]``.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> dict[str, object]:
    head = text.split("\n\n", 1)[0]
    return {
        "scans": len(re.findall(r"Scan parquet", head)),
        "pushed": len(re.findall(r"^PushedFilters: \[.+\]", text, re.M)),
        "pruned_partitions": len(re.findall(r"^PartitionFilters: \[.+\]", text, re.M)),
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange \(", head)),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin", head)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", head)),
        "python_nodes": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", head)),
        "top_k": len(re.findall(r"TakeOrderedAndProject", head)),
    }


def main() -> None:
    from carelens.session import get_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for name, q in E.core_queries().items():
        s = summary(plan_text(q(spark, sf)))
        rows.append((name, s))
    cols = list(rows[0][1])
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
