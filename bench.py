"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from agora import catalog, session

HEADLINE = (
    "posts_canonical", "text_clean_full", "filter_cascade", "filter_stats", "flagship_trend_share", "topic_prevalence", "topic_trends", "engagement", "yearly_stats_by_tag", "time_series_share_week",
    "flow_table", "stage_assign", "pain_points", "stage_summary", "common_terms", "ctfidf_words", "topic_info", "tfidf_merge", "centroid_farthest", "rate_limit_window",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, one run each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
