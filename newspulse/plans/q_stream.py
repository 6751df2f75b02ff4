"""Queries that run Structured Streaming jobs over delivered files."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.plans import fixtures as fx
from newspulse.plans.q_sentiment import REFINE_SQL, SCORED_SQL
from newspulse.plans.registry import query
from newspulse.session import scratch_path
from newspulse.streaming import jobs, store

# Row groups by key modulo 3; the second group arrives twice.
DELIVERIES = ((0, 1), (2, 1))


def _events(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("https://news.example/e/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_type"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"),
        "event_id",
    )


def _deliver(rows, key, folder, run):
    """Drop the rows in two deliveries that overlap.

    The job is stopped and started again from its checkpoint in between.
    """
    for parts in DELIVERIES:
        rows.where((F.col(key) % 3).isin(list(parts))).write.mode("append").parquet(folder)
        run().awaitTermination()


@query(
    "stream_ingest",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
 GROUP BY 1, 2""",
)
def stream_ingest(spark, sf):
    path = scratch_path(spark, "ingest")
    schema = fx.table(spark, sf, "events").schema
    rows = jobs.article_stream(spark, sf, schema, pathGlobFilter="events.parquet")
    jobs.ingest(rows, f"{path}/rows", f"{path}/checkpoint", once=True).awaitTermination()
    saved = spark.read.schema(schema).parquet(f"{path}/rows")
    return saved.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS date_only, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS sentiment_mean, count(value) AS article_count
 FROM events GROUP BY 1""",
)
def stream_daily(spark, sf):
    path = scratch_path(spark, "daily")
    schema = fx.table(spark, sf, "events").schema
    rows = jobs.article_stream(spark, sf, schema, pathGlobFilter="events.parquet")
    rows = rows.withColumn("value", F.round(F.col("value") * 100).cast("long"))
    jobs.write_daily(jobs.daily_windows(rows, "ts", "value"), f"{path}/log", f"{path}/checkpoint", True).awaitTermination()
    return jobs.latest_daily(spark, f"{path}/log")


@query(
    "stream_dedup",
    "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS urls FROM events GROUP BY 1",
)
def stream_dedup(spark, sf):
    """All deliveries in one run, a file a batch: repeats meet inside a batch or the state."""
    path = scratch_path(spark, "dedup")
    rows = _events(spark, sf)
    for parts in DELIVERIES:
        rows.where((F.col("event_id") % 3).isin(list(parts))).write.mode("append").parquet(f"{path}/in")
    stream = jobs.article_stream(spark, f"{path}/in", rows.schema, files_per_batch=1)
    jobs.ingest_new(stream, f"{path}/store", f"{path}/checkpoint", once=True).awaitTermination()
    saved = store.read_store(spark, f"{path}/store", rows.schema)
    return saved.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


@query("stream_resume", "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_resume(spark, sf):
    """Stopped after each delivery and resumed; a repeat changes nothing."""
    path = scratch_path(spark, "resume")
    rows = _events(spark, sf)

    def run():
        stream = jobs.article_stream(spark, f"{path}/in", rows.schema)
        return jobs.ingest_new(stream, f"{path}/store", f"{path}/checkpoint", once=True)

    _deliver(rows, "event_id", f"{path}/in", run)
    saved = store.read_store(spark, f"{path}/store", rows.schema)
    return saved.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _refreshed(spark, sf, lookback_days, as_of=None):
    path = scratch_path(spark, "refresh")
    rows = fx.news(spark, sf).select("doc_id", "title", "content", "date", "press", "url")
    settings = jobs.RefreshSettings(
        fx.POSITIVE, fx.NEGATIVE, lexicon_correction=True, threshold=fx.NEWS_THRESHOLD,
        lookback_days=lookback_days, as_of=as_of,
    )

    def run():
        stream = jobs.article_stream(spark, f"{path}/in", rows.schema)
        return jobs.refresh(stream, path, f"{path}/checkpoint", settings, once=True)

    _deliver(rows, "doc_id", f"{path}/in", run)
    return path


FINAL_SQL = f"""{SCORED_SQL}, final AS (
  SELECT doc_id, date_only, title, url, confidence, f AS sentiment, date,
         CASE f WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS sentiment_num
  FROM (SELECT *, {REFINE_SQL} AS f FROM scored))"""


@query(
    "incremental_refresh",
    f"""WITH {FINAL_SQL}, {fx.daily_sql('final')} SELECT strftime(date_only, '%Y-%m-%d') AS date, rank, title, sentiment FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.date_only ORDER BY f.confidence DESC, f.url) AS rank
  FROM final f JOIN changes c USING (date_only) WHERE abs(c.change) >= {fx.NEWS_THRESHOLD}) WHERE rank <= 3""",
)
def incremental_refresh(spark, sf):
    return jobs.published(spark, _refreshed(spark, sf, None), "event_news")


@query(
    "incremental_daily",
    f"""WITH {FINAL_SQL}, cut AS (SELECT max(date)::TIMESTAMP - INTERVAL 1 HOUR - INTERVAL 30 DAYS AS c FROM final),
 recent AS (SELECT * FROM final WHERE date::TIMESTAMP > (SELECT c FROM cut)), {fx.daily_sql('recent')}
 SELECT strftime(date_only, '%Y-%m-%d') AS date_only, round(sentiment_mean, 6) AS sentiment_mean, article_count,
        round(prev, 6) AS prev, round(change, 6) AS change FROM changes""",
)
def incremental_daily(spark, sf):
    last = fx.news(spark, sf).agg(F.max(F.to_timestamp("date")) - F.expr("INTERVAL 1 HOUR")).first()[0]
    return jobs.published(spark, _refreshed(spark, sf, 30, str(last)), "daily")
