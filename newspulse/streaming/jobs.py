"""Streaming jobs: ingest, dedup, daily windows, incremental refresh."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newspulse.functions import fixed, text
from newspulse.functions.dates import parse_timestamp
from newspulse.operators import daily as ops
from newspulse.operators.ranking import top_k_per_group
from newspulse.operators.scoring import refine_articles, score_with_lexicon
from newspulse.streaming import store

log = logging.getLogger(__name__)
POLL_INTERVAL = "300 seconds"
DAY_STATE = "date_only date, total long, article_count long"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEADLINES = "date_only date, title string, final_sentiment string, confidence double, url string"


def article_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int | None = None, **options: str
) -> DataFrame:
    """Rows of files as they arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Run ``work`` on every micro-batch, each poll or until all is read."""
    trigger = {"availableNow": True} if once else {"processingTime": POLL_INTERVAL}
    return (
        stream.writeStream.foreachBatch(work)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def supervise(start_query: Callable[[], StreamingQuery], pause: float = 300.0, max_failures: int | None = None) -> int:
    """Keep a job running: after an error wait and start it again.

    The checkpoint makes the failed batch run again. Returns the number of
    failures once the job ends by itself; gives up, with the error, after
    ``max_failures`` of them.
    """
    failures = 0
    while True:
        try:
            start_query().awaitTermination()
            return failures
        except StreamingQueryException:
            failures += 1
            if max_failures is not None and failures >= max_failures:
                raise
            log.exception("stream failed, starting again in %s seconds", pause)
            time.sleep(pause)


def ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append arriving rows to a table; the file sink commits each file once."""
    trigger = {"availableNow": True} if once else {"processingTime": POLL_INTERVAL}
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def first_seen(stream: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key no earlier batch had, one per key; a missing key is a key.

    The keys are state of the stream, without expiry, in RocksDB on the
    executors and in the checkpoint: a batch looks up its own keys and saves
    what it adds, however many there are. Of rows of one batch with the same
    key the one that Spark meets first stays.
    """
    conf = stream.sparkSession.conf
    if conf.get(STATE_PROVIDER, None) != ROCKSDB:
        conf.set(STATE_PROVIDER, ROCKSDB)
        conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream.dropDuplicates([key])


def ingest_new(stream: DataFrame, root: str, checkpoint: str, key: str = "url", once: bool = False) -> StreamingQuery:
    """Append only rows whose key is not stored, one per key.

    A batch that is run again sees the state of the batch before and
    overwrites its own folder.
    """
    store.guard_store(stream.sparkSession, root, checkpoint)
    return start(first_seen(stream, key), lambda batch, i: store.write_batch(batch, root, i), checkpoint, once)


def dedup_within_watermark(stream: DataFrame, ts: str, key: str, delay: str = "30 days") -> DataFrame:
    """Bounded-memory form: a repeat older than the delay passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_windows(stream: DataFrame, ts: str, value: str, delay: str = "30 days") -> DataFrame:
    """Mean and count per day; rows later than the delay are dropped."""
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.avg(value).alias("sentiment_mean"), F.count(value).alias("article_count"))
        .select(F.to_date("w.start").alias("date_only"), "sentiment_mean", "article_count")
    )


def write_daily(stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Log the days each batch changed; ``latest_daily`` resolves the log."""
    store.guard_store(stream.sparkSession, root, checkpoint)
    return start(stream, lambda batch, i: store.write_batch(batch, root, i), checkpoint, once, mode="update")


def latest_daily(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every day in a log of updates."""
    log = spark.read.schema(
        "date_only date, sentiment_mean double, article_count long, batch long"
    ).parquet(root)
    return top_k_per_group(log, ["date_only"], [F.desc("batch")], 1).drop("batch")


@dataclass
class RefreshSettings:
    """What one refresh computes; the defaults are the polling form."""

    positive: Sequence[str] = field(default_factory=lambda: fixed.POSITIVE_WORDS)
    negative: Sequence[str] = field(default_factory=lambda: fixed.NEGATIVE_WORDS)
    scorer: Callable[[DataFrame], DataFrame] | None = None
    lexicon_correction: bool = False
    threshold: float = fixed.EVENT_THRESHOLD
    min_count: int = fixed.MIN_ARTICLES_PER_DAY
    lookback_days: int | None = fixed.LOOKBACK_DAYS
    as_of: str | None = None
    headlines: int = 3


def score_batch(articles: DataFrame, settings: RefreshSettings) -> DataFrame:
    """Score, refine and summarise new articles; adds their day."""
    with_text = articles.withColumn("model_text", text.model_text("title", "content"))
    scorer = settings.scorer or (lambda df: score_with_lexicon(df, settings.positive, settings.negative))
    refined = refine_articles(
        scorer(with_text).drop("model_text"), settings.positive, settings.negative, settings.lexicon_correction
    )
    return refined.withColumn("ts", parse_timestamp("date")).withColumn("date_only", F.to_date("ts"))


def _sums(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("date_only").isNotNull())
        .groupBy("date_only")
        .agg(F.sum("sentiment_num").alias("total"), F.count("sentiment_num").alias("article_count"))
    )


def _best_headlines(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("confidence").desc_nulls_last(), F.col("url").asc_nulls_last()]
    return top_k_per_group(rows, ["date_only"], order, k)


def recent_days(days: DataFrame, scored: DataFrame, settings: RefreshSettings) -> DataFrame:
    """Day sums inside the lookback.

    Only the day the lookback starts in needs article rows again; the store
    is partitioned by day, so that is one folder per batch.
    """
    if settings.lookback_days is None:
        return days
    as_of = F.current_timestamp() if settings.as_of is None else F.lit(settings.as_of).cast("timestamp")
    cutoff = as_of - F.expr(f"INTERVAL {settings.lookback_days} DAYS")
    whole = days.where(F.col("date_only") > F.to_date(cutoff))
    first = scored.where((F.col("date_only") == F.to_date(cutoff)) & (F.col("ts") > cutoff))
    return whole.unionByName(_sums(first))


def stored_schema(spark: SparkSession, incoming: StructType | str, settings: RefreshSettings) -> StructType:
    """Schema of stored articles; the partition column comes last."""
    schema = score_batch(spark.createDataFrame([], incoming), settings).schema
    return StructType([f for f in schema if f.name != "date_only"]).add("date_only", "date")


def rewrite_refresh_store(spark: SparkSession, root: str, new_root: str, schema: StructType, last_batch: int) -> None:
    """Move a stopped refresh to a new root with one folder per table."""
    store.rewrite_store(spark, f"{root}/articles", f"{new_root}/articles", schema, last_batch, "date_only")
    for name, fields in (("day_state", DAY_STATE), ("headline_state", HEADLINES)):
        store.write_batch(store.read_batch(spark, f"{root}/{name}", last_batch, fields), f"{new_root}/{name}", last_batch)


def refresh(stream: DataFrame, root: str, checkpoint: str, settings: RefreshSettings, once: bool = False) -> StreamingQuery:
    """Store new articles and bring daily, events and event_news up to date.

    Urls seen before are dropped by the stream's own state, and a batch adds
    its day sums and best headlines to those of the batch before, so history
    is not read again. ``published`` gives the result tables.

    A micro-batch runs without adaptive execution, where the rebalance by day
    does nothing and every task writes a file for every day. So the scored
    batch is written as it comes and dealt by day in the session of the caller.
    """
    spark = stream.sparkSession
    articles, day_state, headline_state = f"{root}/articles", f"{root}/day_state", f"{root}/headline_state"
    store.guard_store(spark, day_state, checkpoint)
    schema = stored_schema(spark, stream.schema, settings)

    def work(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, settings).write.mode("overwrite").parquet(f"{root}/incoming")
        arrived = spark.read.schema(schema).parquet(f"{root}/incoming")
        store.write_batch(arrived, articles, batch_id, partition_by="date_only")

        days = store.read_batch(spark, day_state, batch_id - 1, DAY_STATE).unionByName(_sums(arrived))
        days = days.groupBy("date_only").agg(*[F.sum(c).alias(c) for c in ("total", "article_count")])
        store.write_batch(days, day_state, batch_id)
        best = store.read_batch(spark, headline_state, batch_id - 1, HEADLINES).unionByName(
            arrived.where(F.col("date_only").isNotNull()).select(
                "date_only", "title", "final_sentiment", "confidence", "url"
            )
        )
        store.write_batch(_best_headlines(best, settings.headlines), headline_state, batch_id)
        publish(spark, root, batch_id, schema, settings)

    return start(first_seen(stream), work, checkpoint, once)


def publish(spark: SparkSession, root: str, batch_id: int, schema: StructType, settings: RefreshSettings) -> None:
    """Write daily, events and event_news from the state of a batch.

    Two slots take turns and a mark is written last, so a reader of
    ``published`` finds whole tables of one batch while the next is written.
    """
    slot = f"slot={batch_id % 2}"

    def write(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{root}/out/{name}/{slot}")
        return spark.read.schema(rows.schema).parquet(f"{root}/out/{name}/{slot}")

    days = store.read_batch(spark, f"{root}/day_state", batch_id, DAY_STATE)
    scored = store.read_store(spark, f"{root}/articles", schema, before=batch_id + 1)
    recent = recent_days(days, scored, settings)
    means = recent.where(F.col("article_count") >= settings.min_count).select(
        "date_only", (F.col("total") / F.col("article_count")).alias("sentiment_mean"), "article_count"
    )
    written = write(ops.with_change(means), "daily")
    events = write(written.where(F.abs("change") >= settings.threshold), "events")
    headlines = store.read_batch(spark, f"{root}/headline_state", batch_id, HEADLINES)
    write(ops.event_news(headlines, events, settings.headlines), "event_news")
    write(spark.createDataFrame([(batch_id,)], "batch long"), "complete")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A result table of the newest batch whose results are complete."""
    marks = spark.read.schema("batch long, slot int").parquet(f"{root}/out/complete")
    slot = marks.orderBy(F.desc("batch")).first()["slot"]
    return spark.read.parquet(f"{root}/out/{name}/slot={slot}")
