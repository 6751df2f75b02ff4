"""Polarity per day and month, change events and the articles behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.functions import fixed, text
from newspulse.functions.dates import year_month
from newspulse.operators.ranking import top_k_per_group
from newspulse.operators.rows import exploded
from newspulse.session import settle


def daily_sentiment(
    articles: DataFrame, day: str = "date_only", value: str = "sentiment_num", min_count: int = fixed.MIN_ARTICLES_PER_DAY
) -> DataFrame:
    """Mean polarity and number of scored articles per day with support."""
    daily = (
        articles.where(F.col(day).isNotNull())
        .groupBy(F.col(day).alias("date_only"))
        .agg(F.avg(value).alias("sentiment_mean"), F.count(value).alias("article_count"))
    )
    return daily.where(F.col("article_count") >= min_count)


def within_lookback(
    articles: DataFrame, ts: str, as_of: Column, days: int | None = fixed.LOOKBACK_DAYS
) -> DataFrame:
    """Rows strictly newer than ``as_of`` minus ``days``; ``None`` keeps all."""
    if days is None:
        return articles
    return articles.where(F.col(ts) > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def with_change(daily: DataFrame, value: str = "sentiment_mean", order: str = "date_only") -> DataFrame:
    """Previous kept day and difference; runs over one row per day."""
    w = Window.orderBy(order)
    return daily.withColumn("prev", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("prev"))


def change_events(daily: DataFrame, threshold: float = fixed.EVENT_THRESHOLD) -> DataFrame:
    return with_change(daily).where(F.abs("change") >= threshold)


def event_type(change: Column | str, surge: str = fixed.SURGE, plunge: str = fixed.PLUNGE) -> Column:
    return F.when(text.as_col(change) > 0, surge).otherwise(plunge)


def monthly_trend(articles: DataFrame, day: str = "date_only", value: str = "sentiment_num") -> DataFrame:
    return (
        articles.where(F.col(day).isNotNull())
        .groupBy(year_month(day).alias("year_month"))
        .agg(F.avg(value).alias("sentiment_avg"), F.count(value).alias("count"))
    )


def event_news(articles: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most confident articles of every event day, ties by url.

    ``events`` should be a settled table: the articles meet it first, so that
    a store by day is pruned and only rows of event days are ranked; of those
    at most ``k`` per day and task are shuffled.
    """
    on_days = articles.where(F.col("date_only").isNotNull()).select(
        "date_only", "title", "final_sentiment", "confidence", "url"
    ).join(events.select("date_only").distinct(), "date_only", "left_semi")
    top = top_k_per_group(
        on_days,
        ["date_only"],
        [F.col("confidence").desc_nulls_last(), F.col("url").asc_nulls_last()],
        k,
        "rank",
    )
    return top.select(
        F.col("date_only").alias("date"), "rank", "title", F.col("final_sentiment").alias("sentiment")
    )


def event_keywords(articles: DataFrame, events: DataFrame, order: str, pattern: str = fixed.HANGUL_WORD, n: int = 5) -> DataFrame:
    """The ``n`` most frequent words over all texts of an event day.

    ``events`` should be a settled table. Each article counts its own words
    first; ties go to the word that appears first in article order.
    """
    on_days = articles.select("date_only", order, "content").join(events.select("date_only"), "date_only")
    counted = exploded(
        on_days, "date_only", order, array=text.term_counts(text.words("content", pattern)), name="t"
    )
    per_day = counted.groupBy("date_only", F.col("t.word").alias("word")).agg(
        F.sum("t.n").alias("n"),
        F.min(order).alias("first_article"),
        F.min_by("t.first_pos", order).alias("first_pos"),
    )
    return top_k_per_group(
        per_day, ["date_only"], [F.desc("n"), F.asc("first_article"), F.asc("first_pos")], n, "rank"
    ).select("date_only", "rank", "word", "n")


def event_summary(articles: DataFrame, events: DataFrame, order: str, n: int = 3) -> DataFrame:
    """First ``n`` sentences of a day's texts, put together in article order.

    A sentence goes on into the next article when a text ends without a
    terminator. The cut is found first: among a day's articles that contain
    a break, the first ``n`` are enough to see the ``n``-th break. Only
    articles up to that one are gathered, each clipped to ``n`` sentences:
    exactly the texts that the summary is cut from. They are put together in
    two levels, ranges of a day's articles first, so that only the texts of
    the ranges meet in the day's row. That row itself is as long as the
    definition makes it: a day without a sentence end keeps all its texts.
    ``events`` should be a settled table; ``order`` must be unique.
    """
    texts = articles.where(text.ends_sentence("content")).select(
        "date_only", order, text.sentence_breaks("content", n).alias("_breaks")
    )
    breaking = top_k_per_group(
        texts.join(events.select("date_only"), "date_only"), ["date_only"], [F.asc(order)], n
    )
    seen = Window.partitionBy("date_only").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = (
        breaking.withColumn("_seen", F.sum("_breaks").over(seen))
        .where(F.col("_seen") >= n)
        .groupBy("date_only")
        .agg(F.min(order).alias("_last"))
    )
    cuts = settle(events.select("date_only").join(last, "date_only", "left"), "summary-cuts")
    kept = (
        articles.where(~text.is_blank("content"))
        .select("date_only", order, "content")
        .join(cuts, "date_only")
        .where(F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
        .select("date_only", order, text.lead_summary("content", n).alias("_text"))
    )
    ranged = kept.repartitionByRange("date_only", order).withColumn("_range", F.spark_partition_id())
    ranges = _joined(settle(ranged, "summary-ranges"), ["date_only", "_range"], order, "_text")
    whole = _joined(ranges.withColumn("_text", text.lead_summary("_text", n)), ["date_only"], "_range", "_text")
    return whole.select("date_only", text.lead_summary("_text", n).alias("summary"))


def _joined(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The values of each key as one text, in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("t"))))
    return rows.groupBy(*keys).agg(parts.alias("_parts")).select(
        *keys, F.array_join(F.transform("_parts", lambda p: p["t"]), " ").alias(value)
    )
