"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import time

from folioscope.catalog import QUERIES
from folioscope.session import build_session

HEADLINE = [
    "token_stats", "profile_terms", "remote_profile", "paper_score", "paper_topk",
    "diverse_select", "baseline_select", "recommend", "pool_merge", "cdc_merge", "ledger_append",
    "outcome_attribution", "position_outcomes", "latest_label", "snapshot_header", "eval_splits",
    "rank_metrics", "ablation_report", "efficiency_medians", "quality_support", "sensitive_scan",
    "html_text", "citation_context", "stream_events",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "folioscope-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
