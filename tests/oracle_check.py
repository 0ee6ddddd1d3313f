"""Run each Spark query and its DuckDB oracle side by side and compare.

Comparison: same column names (sorted), same row count, and the same
multiset of rows after normalising values (dates to ISO text, integral
floats to ints, floats rounded to 9 significant digits, NULL kept).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and STRICT:
        return repr(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        return float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict[str, dict]:
    import __spark_entry__ as E
    qs, sql = E.core_queries(), E.core_oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        scols = sdf.columns
        srows = [tuple(r) for r in sdf.collect()]
        t1 = time.time()
        res = {"spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
        if name in sql:
            cur = con.execute(sql[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            res["oracle_rows"] = len(drows)
            res["columns_match"] = sorted(scols) == sorted(dcols)
            res["values_match"] = res["columns_match"] and _rows(scols, srows) == _rows(dcols, drows)
            if not res["values_match"] and verbose:
                a, b = _rows(scols, srows), _rows(dcols, drows)
                diff_a = [r for r in a if r not in b][:3]
                diff_b = [r for r in b if r not in a][:3]
                res["detail"] = {"spark_cols": scols, "oracle_cols": dcols,
                                 "spark_only": diff_a, "oracle_only": diff_b}
        report[name] = res
        if verbose:
            print(name, res, flush=True)
    return report


if __name__ == "__main__":
    from carelens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    rep = compare(spark, sf, only)
    bad = [k for k, v in rep.items() if not v.get("values_match", True)]
    print("MISMATCH:", bad)
