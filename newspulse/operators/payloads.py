"""Records delivered to other services, as struct columns or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import text, urls
from newspulse.functions.dates import iso_like
from newspulse.operators.daily import event_keywords, event_summary, event_type
from newspulse.functions import fixed


def news_payload(articles: DataFrame, stock_code: str, source: str) -> DataFrame:
    """The twelve fields of a news record."""
    return articles.select(
        F.lit(stock_code).alias("stockCode"),
        text.collapse_spaces("title").alias("title"),
        text.collapse_spaces("content").alias("content"),
        text.lead_summary("content").alias("summary"),
        F.lit(source).alias("source"),
        F.col("url"),
        urls.url_hash("url").alias("urlHash"),
        iso_like("date").alias("publishedAt"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("sentimentScore"),
        F.lower(F.coalesce(F.col("final_sentiment"), F.lit("neutral"))).alias("sentimentLabel"),
        F.lit("NONE").alias("eventTags"),
        F.lit(True).alias("isRepresentative"),
    )


def event_payload(
    articles: DataFrame, events: DataFrame, stock_code: str, order: str, pattern: str = fixed.HANGUL_WORD
) -> DataFrame:
    """One record per event day with keywords and summary.

    ``events`` should be a settled table; all joins are on one row per day.
    """
    keywords = (
        event_keywords(articles, events, order, pattern)
        .groupBy("date_only")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("_k"))
        .select("date_only", F.array_join(F.transform("_k", lambda k: k["word"]), ", ").alias("keyword"))
    )
    summary = event_summary(articles, events, order)
    joined = events.join(keywords, "date_only", "left").join(summary, "date_only", "left")
    return joined.select(
        F.lit(stock_code).alias("stockCode"),
        F.date_format("date_only", "yyyy-MM-dd").alias("eventDate"),
        event_type("change").alias("eventType"),
        F.col("change").alias("changeRate"),
        F.coalesce("keyword", F.lit("")).alias("keyword"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def as_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))
