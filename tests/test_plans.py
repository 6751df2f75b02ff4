"""Plans: pruned scans, limits before the shuffle, no repeated expressions."""

import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

from newspulse.operators import daily, keywords, pages, state
from newspulse.operators.ranking import first_per_key
from newspulse.plans import catalog, fixtures as fx
from newspulse.session import settle

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def tree(df):
    return plan(df).split("\n\n")[0]


def test_daily_reads_two_columns_and_aggregates_before_the_shuffle(spark):
    text = plan(daily.daily_sentiment(fx.signal(spark, SF_DIR)))
    assert "ReadSchema: struct<l_returnflag:string,l_shipdate:timestamp_ntz>" in text
    assert "PushedFilters" in text and "IsNotNull(l_shipdate)" in text
    assert text.index("partial_avg") < text.index("hashpartitioning")


def test_group_limit_runs_on_both_sides_of_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    limited = tree(first_per_key(rows, ["k"], [F.asc("id")]))
    assert limited.count("WindowGroupLimit") == 2


def test_label_report_reads_no_text(spark):
    assert "text:string" not in plan(catalog.QUERIES["label_distribution"](spark, SF_DIR))
    assert "content" not in plan(catalog.QUERIES["monthly_trend"](spark, SF_DIR))


def test_settled_events_are_broadcast_by_their_size(spark):
    articles = fx.scored_news(spark, SF_DIR)
    events = settle(daily.change_events(daily.daily_sentiment(articles), fx.NEWS_THRESHOLD), "t")
    joined = tree(daily.event_keywords(articles, events, "doc_id", fx.WORD))
    assert "BroadcastHashJoin" in joined
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
        assert "SortMergeJoin" in tree(daily.event_keywords(articles, events, "doc_id", fx.WORD))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_known_keys_scan_the_store_without_shuffling_it(spark):
    stored = fx.news(spark, SF_DIR).select("url")
    keys = settle(stored.limit(5).select(F.col("url").alias("_key")), "t")
    hits = stored.join(keys, F.col("url").eqNullSafe(F.col("_key")), "left_semi")
    assert "BroadcastHashJoin" in tree(hits)
    assert state.known_keys(stored.limit(5), stored).count() == 5


def test_tokens_are_extracted_once(spark):
    text = plan(keywords.word_counts(fx.token_docs(spark, SF_DIR)))
    assert text.count("regexp_extract_all") == 1


def test_page_body_is_computed_once(spark):
    found = pages.extract_articles(fx.table(spark, SF_DIR, "pages"), fx.BOILERPLATE)
    text = plan(pages.accepted_articles(found))
    assert len(re.findall("Released under", text)) == 1


@pytest.mark.parametrize(
    "name", ["heaps_curve", "zipf_curve", "frontier_progress", "upsert_by_key", "class_top_words", "event_keywords", "tagging_sample"]
)
def test_no_row_level_window_runs_on_one_partition(spark, name):
    """What meets in one partition has been aggregated or limited by group before."""
    lines = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+*|()\d-]*", line)[0])
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = [x for x in itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])]
            assert any("Aggregate" in x or "Limit" in x for x in below), "\n".join(lines[i:])


def test_no_cross_join_and_no_local_checkpoint_in_the_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "newspulse")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    source = f.read()
                assert "crossJoin(" not in source and "localCheckpoint" not in source, name
