"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once cold and once warm; ``queries`` holds the warm seconds of planning
and running to the last row, ``cold`` the first ones. Results are drained with the
``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pagemill.queries import QUERIES  # noqa: E402

HEADLINE = (
    "page_tokens", "page_spans", "listing_links", "ordered_distinct_links", "prefix_until_gap", "fill_to_limit",
    "page_titles", "article_text", "content_exclude", "content_include", "clean_content", "excerpt", "content_gate",
    "month_dates", "jsonld_dates", "featured_image", "title_dedup_live", "batch_cut", "terms_assigned",
    "meta_wide", "profile_effective", "reconcile_schedule", "stream_dedup_url", "import_dry", "import_live",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    times: dict[str, list[float]] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.setdefault(name, []).append(round(time.perf_counter() - start, 3))
    warm = {n: t[-1] for n, t in times.items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": {n: t[0] for n, t in times.items()},
                "pages_per_sec_import": round(pages / warm["import_live"], 1), "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
