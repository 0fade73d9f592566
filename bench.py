"""Benchmark: headline funnel queries on the driver tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 2; the best run of each query is reported).

Prints one JSON line:
  {"metric": "funnel_refresh", "value": <sec>, "unit": "sec",
   "queries": {name: sec, ...}, "sf": ...}

``value`` is one full dashboard refresh: every payload table (KPIs, date
span, scored tree, three consolidated views, rankings, alerts,
recommendations, digest) computed from the stored funnel tables and written
as a Parquet snapshot, sharing the stored per-group intermediates.  ``queries`` are the registered
queries run independently (each from the raw tables).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adfunnel.plans import registry  # noqa: E402
from adfunnel.session import checkpoint_dir, local_session  # noqa: E402
from adfunnel.sources.fixtures import FIXTURE_CONFIG, silver_tables  # noqa: E402
from adfunnel import Funnel  # noqa: E402

HEADLINE = [
    "campaign_performance",
    "performance_tree",
    "kpis",
    "campaigns_flat",
    "adsets_flat",
    "creatives_flat",
    "top_creatives",
    "rule_alerts",
    "recommendations",
    "digest_lines",
    "ads_rollup",
    "leads_by_level",
]


def _timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def refresh(spark, sf_dir: str) -> None:
    f = Funnel(silver_tables(spark, sf_dir), FIXTURE_CONFIG, materialize=True)
    f.write_outputs(f"{checkpoint_dir(spark)}/bench-gold-{uuid.uuid4().hex[:8]}")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="adfunnel-bench")
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()

    # Warm-up (JIT, file listing caches) on a cheap query; not reported.
    qs["ads_totals"](spark, sf_dir).collect()

    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            t = _timed(lambda: qs[name](spark, sf_dir).collect())
            best = t if best is None else min(best, t)
        times[name] = round(best, 3)

    best_refresh = None
    for _ in range(repeats):
        t = _timed(lambda: refresh(spark, sf_dir))
        best_refresh = t if best_refresh is None else min(best_refresh, t)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "funnel_refresh",
        "value": round(best_refresh, 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
