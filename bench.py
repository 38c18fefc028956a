"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pulsegrid.plans import catalog
from pulsegrid.session import build

HEADLINE = (
    "top_failing_tests", "flaky_scores_pipeline", "run_anomaly_zscore", "week_on_week", "flakiness_features", "drift_report", "sankey_edges", "peak_windows",
    "tfidf_top_terms", "defect_candidates_band", "hybrid_mappings", "coverage_kpis", "duplicate_pairs_jaccard", "embedding_max_similarity", "tokenise_stats",
    "prioritisation", "adjusted_rand_index", "upsert_replace", "failure_clusters", "run_anomaly_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build(f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["pass_rate_by_run"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
