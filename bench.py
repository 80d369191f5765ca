"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from driftline.plans import registry

HEADLINE = ["daily_last_value", "forward_fill_3d", "trailing_distinct_30d", "asof_lag_7d", "cohort_percent_rank", "hysteresis_states", "sliding_distinct_threshold", "gate_topk_budget", "reach_lines", "canonical_chain", "components_of_orders_and_parts", "trigram_similarity_join", "regex_mentions", "html_text", "momentum_snapshot", "momentum_score", "momentum_review", "hindcast_trace", "ordered_merge_audit", "claim_edges", "subgraph_digests", "evidence_packs"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.table(spark, folder, "events").count()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
