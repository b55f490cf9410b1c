"""Print the formatted physical plan of registered queries over the materialised fact.

Usage: python scripts/explain_plans.py [sf_dir] [name ...]
Shows per query the number of shuffles (Exchange), broadcasts, scans with their pushed
filters, partition filters and read schema.
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from marginmart.plans.catalog import QUERIES
    from marginmart.session import get_session
    from marginmart.sources import load_enriched
    from marginmart.sources.sinks import materialize

    spark = get_session()
    fact = materialize(load_enriched(spark, sf_dir))
    for name in names or list(QUERIES):
        df = QUERIES[name].on_enriched(fact)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        shuffles = len(re.findall(r"^\(\d+\) Exchange", plan, re.M))
        broadcasts = len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M))
        print(f"== {name}: {shuffles} shuffle(s), {broadcasts} broadcast(s)")
        for m in re.finditer(r"^(PartitionFilters|PushedFilters|ReadSchema): (.*)$", plan, re.M):
            print(f"   {m.group(1)}: {m.group(2)[:150]}")


if __name__ == "__main__":
    main()
