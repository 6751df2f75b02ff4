"""Queries over sources, sinks and stored state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newspulse.operators import keyed, sample, state
from newspulse.plans import batch, fixtures as fx
from newspulse.plans.q_daily import LEAD
from newspulse.plans.q_sentiment import REFINE_SQL, SCORED_SQL
from newspulse.plans.registry import query
from newspulse.session import scratch_path
from newspulse.sinks import files as sinks
from newspulse.sources import files, jdbc

ROWS = "doc_id, title, content, date, press, url, sentiment, round(confidence, 6) AS confidence"
NEWS_SCHEMA = (
    "doc_id long, title string, content string, date string, press string, url string, sentiment string, confidence double"
)


def _rows(spark, sf):
    return fx.news(spark, sf).drop("date_only")


@query("scan_articles", f"WITH {fx.NEWS_SQL} SELECT {ROWS} FROM news")
def scan_articles(spark, sf):
    path = scratch_path(spark, "scan")
    sinks.write_table(_rows(spark, sf), path)
    return files.read_articles(spark, path, schema=NEWS_SCHEMA)


@query("roundtrip_csv", f"WITH {fx.NEWS_SQL} SELECT {ROWS} FROM news")
def roundtrip_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf), path)
    return files.read_articles(spark, path, "csv", NEWS_SCHEMA)


@query("scan_optional", f"WITH {fx.NEWS_SQL} SELECT {ROWS} FROM news")
def scan_optional(spark, sf):
    """Stored rows, of which there are none yet, and this run's rows."""
    stored = files.read_optional(spark, scratch_path(spark, "never-written"), NEWS_SCHEMA)
    return state.append_rows(stored, _rows(spark, sf))


@query("scan_projected", f"WITH {fx.NEWS_SQL} SELECT doc_id AS id, title, content FROM news")
def scan_projected(spark, sf):
    return jdbc.project(_rows(spark, sf).withColumnRenamed("doc_id", "id"), ["id", "title", "content"])


STORED_SQL = f"""{fx.NEWS_SQL}, stored AS (SELECT * FROM news WHERE doc_id % 4 <> 0),
 incoming AS (SELECT * REPLACE ('new ' || title AS title) FROM news WHERE doc_id % 4 IN (0, 1))"""


def _stored_incoming(spark, sf):
    news = _rows(spark, sf)
    part = F.col("doc_id") % 4
    incoming = news.where(part.isin(0, 1)).withColumn("title", F.concat(F.lit("new "), "title"))
    return news.where(part != 0), incoming


@query("new_articles_anti", f"WITH {STORED_SQL} SELECT {ROWS} FROM incoming WHERE url NOT IN (SELECT url FROM stored)")
def new_articles_anti(spark, sf):
    stored, incoming = _stored_incoming(spark, sf)
    return state.new_articles(incoming, stored, [F.col("doc_id")])


@query(
    "append_new",
    f"""WITH {STORED_SQL} SELECT {ROWS} FROM stored
 UNION ALL SELECT {ROWS} FROM incoming WHERE url NOT IN (SELECT url FROM stored)""",
)
def append_new(spark, sf):
    stored, incoming = _stored_incoming(spark, sf)
    return state.append_rows(stored, state.new_articles(incoming, stored, [F.col("doc_id")]))


UPSERT_SQL = f"""WITH {STORED_SQL}, both_ AS (SELECT *, 0 AS v FROM stored UNION ALL SELECT *, 1 FROM incoming)
 SELECT {ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY v DESC, doc_id) AS r FROM both_) WHERE r = 1"""


@query("upsert_unique_store", UPSERT_SQL)
def upsert_unique_store(spark, sf):
    stored, incoming = _stored_incoming(spark, sf)
    return state.upsert(stored, incoming, [F.col("doc_id")], stored_is_unique=True)


@query("upsert_by_key", UPSERT_SQL)
def upsert_by_key(spark, sf):
    stored, incoming = _stored_incoming(spark, sf)
    return state.upsert(stored, incoming, [F.col("doc_id")])


@query(
    "keyed_update",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id AS id, title,
  CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE sentiment END AS sentiment,
  CASE WHEN doc_id % 2 = 0 THEN round((doc_id % 100) / 100.0, 6) END::DOUBLE AS score FROM news""",
)
def keyed_update(spark, sf):
    stored = fx.news(spark, sf).select(F.col("doc_id").alias("id"), "title", "sentiment")
    changes = stored.where(F.col("id") % 2 == 0).select(
        "id", F.lit("updated").alias("sentiment"), ((F.col("id") % 100) / 100.0).alias("score")
    )
    # Every fourth id has a second, later change that must not count.
    again = changes.where(F.col("id") % 4 == 0).withColumn("sentiment", F.lit("again"))
    both = changes.withColumn("step", F.lit(1)).unionByName(again.withColumn("step", F.lit(2)))
    return state.keyed_update(stored, both, "id", ["sentiment", "score"], [F.col("step")])


def _keyed_table(spark, rows):
    name = f"stored_{uuid.uuid4().hex}"
    path = scratch_path(spark, "keyed-table")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed.create_table(rows, name, path, "url", buckets)
    return name, path, buckets


@query("upsert_keyed_table", UPSERT_SQL)
def upsert_keyed_table(spark, sf):
    """A batch is appended to its buckets; the newest row of a key counts."""
    stored, incoming = _stored_incoming(spark, sf)
    name, path, buckets = _keyed_table(spark, stored)
    keyed.append_batch(incoming, 1, name, path, "url", buckets)
    return keyed.current(spark, name, [F.col("doc_id")])


@query("unknown_in_keyed_table", f"WITH {STORED_SQL} SELECT {ROWS} FROM incoming WHERE url NOT IN (SELECT url FROM stored)")
def unknown_in_keyed_table(spark, sf):
    stored, incoming = _stored_incoming(spark, sf)
    name, _, _ = _keyed_table(spark, stored)
    return keyed.unknown_rows(incoming, name, [F.col("doc_id")])


@query(
    "keyed_update_by_day",
    f"""WITH {fx.NEWS_SQL}, last AS (SELECT max(date_only) AS d FROM news)
 SELECT doc_id AS id, title, strftime(date_only, '%Y-%m-%d') AS date_only,
  CASE WHEN doc_id % 2 = 0 AND date_only >= d - 3 THEN 'updated' ELSE sentiment END AS sentiment,
  CASE WHEN doc_id % 2 = 0 AND date_only >= d - 3 THEN round((doc_id % 100) / 100.0, 6) END::DOUBLE AS score FROM news, last""",
)
def keyed_update_by_day(spark, sf):
    """Scores of half of the last days' rows are set in a stored table; earlier days are not touched."""
    rows = fx.news(spark, sf).select(F.col("doc_id").alias("id"), "title", "sentiment", "date_only")
    path = scratch_path(spark, "by-day")
    sinks.write_table(rows, path, partition_by="date_only")
    last = rows.agg(F.max("date_only").alias("last"))
    changes = rows.join(F.broadcast(last), F.col("date_only") >= F.date_sub("last", 3)).where(F.col("id") % 2 == 0).select(
        "id", F.lit("updated").alias("sentiment"), ((F.col("id") % 100) / 100.0).alias("score"))
    return keyed.update_days(spark, path, rows.schema, changes, "id", ["sentiment", "score"])


@query(
    "attach_labels",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id, url, len(regexp_extract_all(lower(content), '\\p{{L}}{{2,}}')) AS n_tokens,
  CASE WHEN doc_id % 5 <> 0 THEN sentiment END AS sentiment,
  CASE WHEN doc_id % 5 <> 0 THEN sentiment_num END::BIGINT AS sentiment_num FROM news""",
)
def attach_labels(spark, sf):
    prepared = fx.news(spark, sf).select(
        "doc_id", "url", F.size(fx.text.words(F.lower("content"), fx.WORD)).alias("n_tokens")
    )
    labels = fx.scored_news(spark, sf).where(F.col("doc_id") % 5 != 0).select("url", "sentiment", "sentiment_num")
    return state.attach_labels(prepared, labels).select("doc_id", "url", "n_tokens", "sentiment", "sentiment_num")


@query(
    "tagging_sample",
    f"""WITH {fx.NEWS_SQL}, quota(predicted, q) AS (VALUES ('positive', 34), ('negative', 33), ('neutral', 33)),
 drawn AS (
  SELECT doc_id, title, substr(content, 1, 200) AS body_start, sentiment AS predicted, confidence, q,
         row_number() OVER (PARTITION BY sentiment ORDER BY md5('42|draw|' || doc_id), doc_id) AS r
  FROM news JOIN quota ON sentiment = predicted)
 SELECT row_number() OVER (ORDER BY md5('42|shuffle|' || doc_id), doc_id) AS number, doc_id, title, body_start, predicted,
        round(confidence, 6) AS confidence, '' AS hand_label, '' AS match,
        count(*) OVER (PARTITION BY predicted) = q AS quota_met
 FROM drawn WHERE r <= q""",
)
def tagging_sample(spark, sf):
    return sample.tagging_sample(fx.news(spark, sf), "doc_id")


@query(
    "score_corpus",
    f"""WITH {SCORED_SQL}, final AS (SELECT *, {REFINE_SQL} AS f FROM scored)
 SELECT doc_id, sentiment, round(confidence, 6) AS confidence, f AS final_sentiment,
        CASE f WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END::BIGINT AS sentiment_num,
        {LEAD('content')} AS summary FROM final""",
)
def score_corpus(spark, sf):
    rows = fx.news(spark, sf).drop("sentiment", "confidence")
    scored = batch.score_corpus(rows, positive=fx.POSITIVE, negative=fx.NEGATIVE)
    return scored.select("doc_id", "sentiment", "confidence", "final_sentiment", "sentiment_num", "summary")
