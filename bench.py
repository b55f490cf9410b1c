"""Benchmark: enrich + materialise the sales fact once, then run every registered query on it.

Prints ONE JSON line:
{"metric": "all_queries_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (optional comma-separated subset), BENCH_SHUFFLE_PARTITIONS,
     BENCH_EVENT_LOG=1 (Spark event log in the run's scratch folder),
     BENCH_WARMUP=0 to skip the JVM warm-up on the sf0.001 sibling folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


#: Queries that are also timed as registered: join and enrichment included, no materialised fact.
REGISTERED = ("yoy_by_affiliate", "kpi_deltas", "grid_affiliate_sport")


def run(df) -> None:
    """Compute every row, and move none to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from marginmart.session import get_session
    scratch = tempfile.mkdtemp(prefix="marginmart-bench-")
    extra = {"spark.local.dir": scratch, "spark.sql.files.maxPartitionBytes": "128m",
             # Small local data: aim post-shuffle partitions at a few MB so all cores work.
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": os.environ.get("BENCH_ADVISORY_PARTITION", "8m"),
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": os.environ.get("BENCH_MIN_PARTITION", "1m")}
    if os.environ.get("BENCH_EVENT_LOG"):
        # Stage and task times for later reading, written to the run's own scratch folder.
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch})
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus))))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=parts,
                        extra=extra)
    from marginmart.plans.catalog import QUERIES
    from marginmart.sources import load_enriched
    from marginmart.sources.sinks import materialize

    # JVM warm-up (class loading, code generation) on the smallest sibling scale factor, if
    # present, so the timings below reflect steady-state work; reported as warmup_sec.
    warm = 0.0
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(small) and small != sf_dir:
        w0 = time.perf_counter()
        small_fact = materialize(load_enriched(spark, small))
        for name in list(QUERIES)[:5]:
            run(QUERIES[name].on_enriched(small_fact))
        warm = round(time.perf_counter() - w0, 3)

    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    fact = materialize(load_enriched(spark, sf_dir))
    fact_rows = fact.count()
    timings["_load_enrich_materialize"] = round(time.perf_counter() - t0, 3)

    names = only or list(QUERIES)
    for name in names:
        fn = QUERIES[name]
        t = time.perf_counter()
        on_fact = getattr(fn, "on_enriched", None)
        df = on_fact(fact) if on_fact is not None else fn(spark, sf_dir)
        run(df)
        timings[name] = round(time.perf_counter() - t, 3)

    registered: dict[str, float] = {}
    for name in REGISTERED if not only else ():
        t = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        registered[name] = round(time.perf_counter() - t, 3)

    query_total = sum(v for k, v in timings.items() if not k.startswith("_"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "all_queries_sec",
        "value": round(query_total, 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "fact_rows": fact_rows,
        "load_enrich_sec": timings["_load_enrich_materialize"],
        "warmup_sec": warm,
        "registered": registered,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
