"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newspulse.plans import catalog  # noqa: E402
from newspulse.session import build_session  # noqa: E402

HEADLINE = (
    "sentiment_events daily_change event_news event_keywords event_summary event_payload news_payload "
    "monthly_trend label_distribution clean_text lead_summary strip_boilerplate tokens doc_keywords word_freq "
    "bigram_freq corpus_stats tfidf_top class_top_words zipf_fit heaps_fit score_articles score_with_model "
    "score_corpus refine_sentiment classification_report confusion_matrix signal_price_corr new_articles_anti "
    "upsert_by_key keyed_update tagging_sample accept_articles reject_reasons page_links tag_inventory "
    "frontier_dedup page_stop_rule stream_daily stream_dedup incremental_refresh"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.newspulse.scanPartitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {cold[name]} {warm[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_second_run", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "first_run": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
