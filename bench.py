"""Time the headline stages and queries; prints one JSON line.

Stage tables (labelled news, tokens, neighbours, components, series, n-gram index) are timed where they are
built; the queries after them read the written tables, as a user of the engine would.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "agg_labels_by_year", "agg_crime_state_year", "agg_states_by_year", "agg_temporal", "agg_monthly_volume", "flt_regex",
    "src_article_extract", "ing_extract", "sem_vocabulary", "sem_tfidf", "agg_cluster_summary", "sem_cluster_network",
    "sem_char_index", "qry_fuzzy_text", "qry_signal_trend", "qry_dual_compare", "sem_knn", "sem_recurring_pairs",
    "sem_components", "sem_series", "sem_consolidate", "qry_series_browse", "rep_report",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("newsatlas-bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from newsatlas.plans import catalog
    from newsatlas.plans.catalog import search, semantic, views

    stages = [
        ("stage_news", views.enriched), ("stage_terms", semantic.terms), ("stage_char_index", search.text_index), ("stage_neighbours", views.neighbours),
        ("stage_components", views.parts), ("stage_series", views.series),
    ]
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times: dict[str, float] = {}
    for name, build in stages:
        start = time.time()
        build(spark, sf_dir)
        times[name] = round(time.time() - start, 3)
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline stages and queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else sf_dir}))


if __name__ == "__main__":
    main()
