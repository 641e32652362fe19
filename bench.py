"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES ('all' or name parts).
Each query runs once to warm up and then BENCH_RUNS times (default 3); its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "s01_extract_articles", "s06_extract_links", "p03_clean_text", "p16_locate_excerpt", "r02_dedup_by_url", "r03_insert_new",
    "f02_filter_any", "j01_tag_entities_word", "j02_tag_entities_substring", "j07_canonicalize_fuzzy", "t01_theme_scores",
    "t04_keywords_by_frequency", "t05_keywords_tfidf", "t08_extract_dates", "t14_categorize", "t15_assign_party", "v01_embed",
    "v03_knn", "v05_knn_join", "v07_filtered_search", "v11_rerank", "v13_retrieve", "v18_pack_context", "a05_categorization_summary",
    "a11_category_stats", "a12_party_month_counts", "a14_category_detail", "o07_party_profile", "o08_figure_profile",
    "e04_classify_responses", "e12_build_digest_input", "e14_period_summary", "i01_ingest_batch",
]


def main() -> None:
    from broadsheet.catalog import QUERIES
    from broadsheet.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not wanted else [n for n in QUERIES if wanted == "all" or any(p in n for p in wanted.split(","))]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        try:
            seconds = []
            for turn in range(runs + 1):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if turn:
                    seconds.append(time.perf_counter() - start)
            times[name] = round(statistics.median(seconds), 3)
        except Exception as error:  # noqa: BLE001
            print(f"{name}: {type(error).__name__}: {str(error)[:300]}", file=sys.stderr)
            times[name] = None
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
