"""Command line: load extracts into a star, write a report, write the cleaned extract.

    python -m carelens load --raw EXTRACTS --star STAR [--append]
    python -m carelens report --star STAR --name NAME [--state ST] [--facility NAME]
                              --out PATH [--format csv|json]
    python -m carelens clean --raw EXTRACTS --out PATH

Run it with ``spark-submit`` on a cluster (the session comes from the
platform), or plainly for a local session.
"""

from __future__ import annotations

import argparse
import hashlib
import sys

from carelens.operators import quality as Q
from carelens.operators.clean import clean_visits, export_cleaned_csv
from carelens.plans import metrics as M
from carelens.plans.append import append_star
from carelens.plans.load import numbered_visits, star_from_raw
from carelens.session import get_session
from carelens.sources.csv import read_raw_visits
from carelens.sources.export import REPORT_FORMATS, export_table_csv, write_json
from carelens.sources.tables import load_star, save_star

REPORTS = {
    "national_breakdown": lambda st, a: M.national_breakdown(st, a.state, order="category"),
    "national_breakdown_by_count": lambda st, a: M.national_breakdown(st),
    "worst_measures": lambda st, a: M.worst_measures(st, a.state, join_hospitals=True),
    "worst_measures_overall": lambda st, a: M.worst_measures(st),
    "worst_hospitals": lambda st, a: M.worst_hospitals(st, a.state),
    "state_scores": lambda st, a: M.state_scores(st),
    "state_map": lambda st, a: M.state_map(st),
    "state_details": lambda st, a: M.state_details(st),
    "common_footnotes": lambda st, a: M.common_footnotes(st),
    "volume_tiers": lambda st, a: M.volume_tiers_by_state(st, a.state),
    "volume_tiers_overall": lambda st, a: M.volume_tiers(st),
    "hospital_profile": lambda st, a: M.hospital_profile(st, a.facility),
    "kpis": lambda st, a: M.kpis(st, a.state),
    "kpi_summary": lambda st, a: M.kpi_summary(st),
    "category_counts": lambda st, a: Q.category_counts(st.performance_data),
    "metric_summary": lambda st, a: Q.metric_summary(st.performance_data),
    "breakdown_check": lambda st, a: Q.breakdown_check(st.performance_data),
    "rank_relabel": lambda st, a: Q.rank_relabel(st.performance_data),
}


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="carelens")
    sub = p.add_subparsers(dest="command", required=True)
    ld = sub.add_parser("load", help="raw CSV extracts -> star tables")
    ld.add_argument("--raw", required=True, help="extract file or folder (header row)")
    ld.add_argument("--star", required=True, help="output folder of the five tables")
    ld.add_argument("--append", action="store_true", help="add to existing tables")
    rp = sub.add_parser("report", help="one report of a stored star")
    rp.add_argument("--star", required=True)
    rp.add_argument("--name", required=True, choices=sorted(REPORTS))
    rp.add_argument("--state", default=None)
    rp.add_argument("--facility", default=None, help="facility name (hospital_profile)")
    rp.add_argument("--out", required=True, help="output folder")
    rp.add_argument("--format", default="csv", choices=["csv", "json"])
    cl = sub.add_parser("clean", help="raw CSV extracts -> cleaned CSV")
    cl.add_argument("--raw", required=True)
    cl.add_argument("--out", required=True, help="output folder")
    return p.parse_args(argv)


def extract_id(spark, path: str) -> str:
    """A name of the extract from its files' paths, sizes and times: the same for a load that is tried again."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").orderBy("path").collect()
    return hashlib.sha256(repr([tuple(f) for f in files]).encode()).hexdigest()[:16]


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or get_session()
    if args.command == "clean":
        export_cleaned_csv(clean_visits(read_raw_visits(spark, args.raw)), args.out)
        return 0
    if args.command == "load":
        raw = read_raw_visits(spark, args.raw)
        if args.append:
            counts = append_star(spark, args.star, lambda start: numbered_visits(raw, [], start=start), extract_id(spark, args.raw))
        else:
            counts = save_star(star_from_raw(raw, order_cols=[]), args.star)
        print(" ".join(f"{k}={v}" for k, v in counts.items()))
        return 0
    if args.name == "hospital_profile" and not args.facility:
        raise SystemExit("hospital_profile needs --facility")
    df = REPORTS[args.name](load_star(spark, args.star), args)
    if args.format == "json":
        write_json(df, args.out)
    else:
        export_table_csv(df, args.out, args.name, args.state, REPORT_FORMATS.get(args.name))
    return 0


if __name__ == "__main__":
    sys.exit(main())
