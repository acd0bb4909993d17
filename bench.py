"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerlens.queries import registry  # noqa: E402
from answerlens.session import build_session  # noqa: E402

HEADLINE = [
    "pf_visible_text", "pf_word_count", "pf_jsonld_types", "pf_internal_links", "pf_js_dependent", "normalise_link",
    "robots_allowed", "ai_access_matrix", "overall_capped", "derive_issues", "check_affected", "crawl_reach",
    "count_mentions", "analyse_response", "scan_answers_serp", "latest_checks", "visibility_history", "current_visibility",
    "competitor_benchmark", "citation_report_data", "site_dashboard", "workspace_kpis", "previous_score", "free_rate_limit",
    "issue_set_status", "order_issues_stored", "build_query", "audit_report_data", "audit_pages_list", "validate_unique", "subscription_state", "stream_daily_visibility", "stream_latest_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
