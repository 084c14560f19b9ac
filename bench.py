"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS choose the data and the cores.
Each query is built anew and written to the no-op sink.  Reduced tables that it
stages are dropped after it, so nothing computed for one query is reused by
another.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import load_all  # noqa: E402
from tidemark.plans.tables import Tables  # noqa: E402
from tidemark.session import drop_staged, local_session  # noqa: E402

HEADLINE = (
    "canonical_bars", "session_features", "exact_session_labels", "price_context", "top_relative_momentum", "price_history_gaps", "setup_match",
    "ttm_rows", "fundamentals_asof", "earnings_asof", "analyst_consensus", "scorecard", "cohort_value_paths", "trailing_news", "member_asof",
    "event_asof", "change_versions", "session_quality", "source_inventory", "page_text", "constraint_violations", "archive_verification",
    "ranked_candidates", "recent_report", "upcoming_report", "training_panel", "interval_identity", "guidance_ranges", "pooled_logistic", "stream_change_versions", "stream_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tidemark-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        known[name].build(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        drop_staged(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
