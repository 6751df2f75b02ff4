"""Queries over daily and monthly polarity, events and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.functions.dates import parse_timestamp
from newspulse.operators import daily as ops
from newspulse.operators import payloads, price
from newspulse.operators.evaluate import label_distribution
from newspulse.plans import fixtures as fx
from newspulse.plans.registry import query
from newspulse.session import settle

D = "strftime(date_only, '%Y-%m-%d')"
_CHANGE = f"{D} AS date_only, round(sentiment_mean, 6) AS sentiment_mean, article_count"
_FULL = _CHANGE + ", round(prev, 6) AS prev, round(change, 6) AS change"


@query("daily_sentiment", f"WITH {fx.SIGNAL_SQL}, {fx.daily_sql('signal')} SELECT {_CHANGE} FROM kept")
def daily_sentiment(spark, sf):
    return ops.daily_sentiment(fx.signal(spark, sf))


@query("daily_change", f"WITH {fx.SIGNAL_SQL}, {fx.daily_sql('signal')} SELECT {_FULL} FROM changes")
def daily_change(spark, sf):
    return ops.with_change(ops.daily_sentiment(fx.signal(spark, sf)))


@query(
    "sentiment_events",
    f"WITH {fx.SIGNAL_SQL}, {fx.daily_sql('signal')} SELECT {_FULL} FROM changes WHERE abs(change) >= 0.5",
)
def sentiment_events(spark, sf):
    return ops.change_events(ops.daily_sentiment(fx.signal(spark, sf)))


@query(
    "daily_mean_all",
    f"WITH {fx.NEWS_SQL}, {fx.daily_sql('news', 1)} SELECT {_FULL} FROM changes",
)
def daily_mean_all(spark, sf):
    return ops.with_change(ops.daily_sentiment(fx.scored_news(spark, sf), min_count=1))


@query(
    "recent_daily",
    f"""WITH {fx.SIGNAL_SQL}, recent AS (
  SELECT * FROM signal WHERE date_only > (SELECT max(date_only) FROM signal) - INTERVAL 30 DAYS),
 {fx.daily_sql('recent')} SELECT {_CHANGE} FROM kept""",
)
def recent_daily(spark, sf):
    signal = fx.signal(spark, sf)
    as_of = signal.agg(F.max("date_only").cast("timestamp")).scalar()
    recent = ops.within_lookback(signal.withColumn("ts", F.col("date_only").cast("timestamp")), "ts", as_of)
    return ops.daily_sentiment(recent)


@query(
    "monthly_trend",
    f"""WITH {fx.NEWS_SQL} SELECT strftime(date_only, '%Y-%m') AS year_month,
  round(avg(sentiment_num), 6) AS sentiment_avg, count(sentiment_num) AS count FROM news GROUP BY 1""",
)
def monthly_trend(spark, sf):
    return ops.monthly_trend(fx.scored_news(spark, sf))


@query(
    "label_distribution",
    f"""WITH {fx.NEWS_SQL} SELECT sentiment AS label, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent,
  round(sum(sum(confidence)) OVER () / sum(count(confidence)) OVER (), 6) AS mean_confidence
 FROM news GROUP BY sentiment""",
)
def labels(spark, sf):
    return label_distribution(fx.news(spark, sf), "sentiment", "confidence")


def news_events(spark, sf, name):
    """Event days of the news, settled so that joins know their size."""
    articles = fx.scored_news(spark, sf)
    return articles, settle(ops.change_events(ops.daily_sentiment(articles), fx.NEWS_THRESHOLD), name)


EVENTS_SQL = f"{fx.NEWS_SQL}, {fx.daily_sql('news')}, events_ AS (SELECT * FROM changes WHERE abs(change) >= {fx.NEWS_THRESHOLD})"


@query(
    "event_news",
    f"""WITH {EVENTS_SQL} SELECT {D} AS date, rank, title, sentiment FROM (
  SELECT n.*, row_number() OVER (PARTITION BY n.date_only ORDER BY n.confidence DESC, n.url) AS rank
  FROM news n JOIN events_ e USING (date_only)) WHERE rank <= 3""",
)
def event_news(spark, sf):
    articles = fx.scored_news(spark, sf)
    return ops.event_news(articles, ops.change_events(ops.daily_sentiment(articles), fx.NEWS_THRESHOLD))


EVENT_WORDS_SQL = rf"""event_words AS (
  SELECT date_only, word, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM (
    SELECT date_only, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
      SELECT date_only, doc_id, regexp_extract_all(content, '\p{{L}}{{2,}}') AS w FROM news JOIN events_ USING (date_only)))
  GROUP BY 1, 2),
 event_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_only ORDER BY n DESC, first) AS rank FROM event_words)
  WHERE rank <= 5)"""


@query(
    "event_keywords",
    f"WITH {EVENTS_SQL}, {EVENT_WORDS_SQL} SELECT {D} AS date_only, rank, word, n FROM event_top",
)
def event_keywords(spark, sf):
    articles, events = news_events(spark, sf, "events")
    return ops.event_keywords(articles, events, "doc_id", fx.WORD)


WS_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COLLAPSE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{WS_SQL}+', ' ', 'g'))"
SPLIT = lambda c: rf"string_split(regexp_replace({COLLAPSE(c)}, '([.!?다요]) ', '\1' || chr(1), 'g'), chr(1))"
LEAD = lambda c: f"array_to_string(list_slice({SPLIT(c)}, 1, 3), ' ')"
EVENT_SUMMARY_SQL = f"""summaries AS (
  SELECT date_only, {LEAD("whole")} AS summary FROM (
    SELECT date_only, string_agg(content, ' ' ORDER BY doc_id) AS whole FROM news JOIN events_ USING (date_only) GROUP BY 1))"""


@query("event_summary", f"WITH {EVENTS_SQL}, {EVENT_SUMMARY_SQL} SELECT {D} AS date_only, summary FROM summaries")
def event_summary(spark, sf):
    articles, events = news_events(spark, sf, "events")
    return ops.event_summary(articles, events, "doc_id")


@query(
    "event_payload",
    f"""WITH {EVENTS_SQL}, {EVENT_WORDS_SQL}, {EVENT_SUMMARY_SQL}
 SELECT 'X01' AS "stockCode", {D} AS "eventDate",
        CASE WHEN change > 0 THEN '{fixed.SURGE}' ELSE '{fixed.PLUNGE}' END AS "eventType",
        round(change, 6) AS "changeRate", coalesce(keyword, '') AS keyword, coalesce(summary, '') AS summary
 FROM events_ LEFT JOIN (SELECT date_only, string_agg(word, ', ' ORDER BY rank) AS keyword FROM event_top GROUP BY 1)
      USING (date_only) LEFT JOIN summaries USING (date_only)""",
)
def event_payload(spark, sf):
    articles, events = news_events(spark, sf, "events")
    return payloads.event_payload(articles, events, "X01", "doc_id", fx.WORD)


@query(
    "news_payload",
    f"""WITH {fx.NEWS_SQL} SELECT 'X01' AS "stockCode", {COLLAPSE("title")} AS title, {COLLAPSE("content")} AS content,
  {LEAD("content")} AS summary, 'wire' AS source, url, sha256(url) AS "urlHash", replace(date, ' ', 'T') AS "publishedAt",
  round(confidence, 6) AS "sentimentScore", sentiment AS "sentimentLabel", 'NONE' AS "eventTags", true AS "isRepresentative"
 FROM news""",
)
def news_payload(spark, sf):
    return payloads.news_payload(fx.scored_news(spark, sf), "X01", "wire")


@query(
    "price_series",
    f"""WITH {fx.PRICE_SQL} SELECT {D} AS date_only, round(close, 6) AS close FROM price
 WHERE date_only >= DATE '1996-01-01' AND date_only < DATE '1998-01-01'""",
)
def price_series(spark, sf):
    return price.price_series(fx.price(spark, sf), start="1996-01-01", end="1998-01-01")


JOINED_SQL = f"""{fx.SIGNAL_SQL}, {fx.PRICE_SQL}, {fx.daily_sql('signal')}, joined AS (
  SELECT date_only, sentiment_mean, close,
         lead(close) OVER (ORDER BY date_only) / close - 1 AS stock_change,
         sentiment_mean - lag(sentiment_mean) OVER (ORDER BY date_only) AS sentiment_change
  FROM kept JOIN price USING (date_only))"""


def _joined(spark, sf):
    return price.signal_price(ops.daily_sentiment(fx.signal(spark, sf)), price.price_series(fx.price(spark, sf)))


@query(
    "signal_price",
    f"""WITH {JOINED_SQL} SELECT {D} AS date_only, round(sentiment_mean, 6) AS sentiment_mean, round(close, 6) AS close,
  round(stock_change, 6) AS stock_change, round(sentiment_change, 6) AS sentiment_change FROM joined""",
)
def signal_price(spark, sf):
    return _joined(spark, sf)


@query(
    "signal_price_corr",
    f"WITH {JOINED_SQL} SELECT count(*) AS days, round(corr(sentiment_mean, stock_change), 6) AS correlation FROM joined",
)
def signal_price_corr(spark, sf):
    return price.signal_price_corr(_joined(spark, sf))


RAW_DATES_SQL = f"""{fx.NEWS_SQL}, raw_dates AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN date WHEN 1 THEN strftime(date_only, '%Y.%m.%d')
         WHEN 2 THEN (doc_id % 23 + 1) || ' hours ago' ELSE '' END AS raw FROM news)"""


@query(
    "parse_dates",
    rf"""WITH {RAW_DATES_SQL} SELECT doc_id, raw,
  strftime(coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y.%m.%d')), '%Y-%m-%d %H:%M:%S') AS parsed,
  regexp_matches(raw, '\d{{4}}[.\-]\d{{2}}[.\-]\d{{2}}|\d+ hours ago') AND length(raw) < 30 AS date_like
 FROM raw_dates""",
)
def parse_dates(spark, sf):
    case = F.col("doc_id") % 4
    raw = (
        F.when(case == 0, F.col("date"))
        .when(case == 1, F.date_format("date_only", "yyyy.MM.dd"))
        .when(case == 2, F.concat((F.col("doc_id") % 23 + 1).cast("string"), F.lit(" hours ago")))
        .otherwise("")
    )
    from newspulse.functions.dates import looks_like_date

    rows = fx.news(spark, sf).select("doc_id", raw.alias("raw"))
    return rows.select(
        "doc_id", "raw",
        F.date_format(parse_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        looks_like_date("raw", fixed.DATE_LIKE_ABSOLUTE + r"|\d+ hours ago").alias("date_like"),
    )
