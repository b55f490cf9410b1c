"""Print one report page (R1-R16) for a scale-factor folder or a pair of CSV exports.

Usage:
  python scripts/report.py /root/testdata/sf0.01 "Executive Summary" [key=value ...]
  python scripts/report.py --csv this.csv last.csv "Risk & Delivery"
Extra key=value pairs are passed to the page (e.g. affiliate="Supplier#000000001",
sports=NBA,NFL metric=Margin dimension=lead_time_bucket).
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _value(v: str):
    if v.isdigit():
        return int(v)
    if "," in v:
        return [x for x in v.split(",") if x]
    return v


def main() -> None:
    args = sys.argv[1:]
    from marginmart.plans.reports import PAGES
    from marginmart.session import get_session
    from marginmart.sources import csv as CSV
    from marginmart.sources import load_enriched

    spark = get_session()
    if args and args[0] == "--csv":
        fact, args = CSV.load_combined(spark, args[1], args[2]), args[3:]
    else:
        fact, args = load_enriched(spark, args[0]), args[1:]
    page = args[0] if args else "Executive Summary"
    if page not in PAGES:
        raise SystemExit(f"unknown page {page!r}; pages: {', '.join(PAGES)}")
    kwargs = dict(a.split("=", 1) for a in args[1:])
    bundle = PAGES[page](fact, **{k: _value(v) for k, v in kwargs.items()})
    for name, df in bundle.items():
        print(f"--- {page}: {name}")
        df.show(20, truncate=False)


if __name__ == "__main__":
    main()
