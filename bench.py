"""Times the headline queries; prints one line of JSON."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from sparkweir.plans import REGISTRY

HEADLINE = (
    "latest_feedback_quality b_all_rows_with_reason b_queue_decisions c_star_join c_fused_latest c_latest_then_filter c_aggregate_left c_anti_with_latest_answer "
    "c_temporal_anti d_report_sections d_rollup_of_distinct_ids d_evaluation e_carried_forward e_preferred f_composite_rank f_sorted_page_with_total i_rule_score j_hashes "
    "k_assessment k_category_by_counts k_primary_candidate k_readiness l_alert_plan a_upsert h_html_fields"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # A query of each sort warms up; of each query's three runs the median counts.
    for name in HEADLINE[:3]:
        seconds(name)
    took = {name: round(statistics.median(seconds(name) for _ in range(3)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
