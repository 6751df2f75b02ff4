"""The batch job, payload records and remaining readers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.operators import daily, frontier, pages, payloads, price
from newspulse.plans import batch, catalog
from newspulse.session import scratch_path, settle
from newspulse.sinks import files as sinks
from newspulse.sources import files, jdbc, schemas

DAY = dt.date(2024, 1, 1)


def test_batch_run_saves_and_reports(spark):
    rows = [
        ("상승 상승", "본문 상승. 둘째다. 셋째요 넷째", "2024-01-01", "p", "u1"),
        ("하락 손실", "위기", "2024-01-01", "p", "u2"),
        ("평범한 제목", None, "2024-01-02", "p", "u3"),
        (None, None, "2024-01-02", "p", "u4"),
    ]
    path = scratch_path(spark, "batch")
    report = batch.run(spark.createDataFrame(rows, schemas.ARTICLE_RAW), path)
    assert sorted((r["label"], r["n"], r["percent"]) for r in report.collect()) == [
        ("negative", 1, 25.0), ("neutral", 2, 50.0), ("positive", 1, 25.0),
    ]
    saved = {r["url"]: r for r in spark.read.parquet(path).collect()}
    assert (saved["u1"]["final_sentiment"], saved["u1"]["sentiment_num"]) == ("positive", 1)
    assert saved["u1"]["summary"] == "본문 상승. 둘째다. 셋째요"
    assert (saved["u4"]["sentiment"], saved["u4"]["confidence"], saved["u4"]["summary"]) == ("neutral", 0.0, "")


def test_payload_records(spark):
    rows = [
        (DAY, 1, " a  b ", "가나 다라. 가나 둘. 셋. 넷", "2024-01-01 09:00:00", "u1", None, None),
        (DAY, 2, "c", "끝", "2024-01-01 10:00:00", "u2", 0.5, "Positive"),
    ]
    articles = spark.createDataFrame(
        rows, "date_only date, id long, title string, content string, date string, url string, confidence double, final_sentiment string"
    )
    path = scratch_path(spark, "payload")
    sinks.write_json_records(payloads.news_payload(articles, "X", "wire"), path)
    records = sorted((json.loads(r[0]) for r in spark.read.text(path).collect()), key=lambda r: r["url"])
    assert list(records[0]) == [
        "stockCode", "title", "content", "summary", "source", "url", "urlHash", "publishedAt", "sentimentScore",
        "sentimentLabel", "eventTags", "isRepresentative",
    ]
    assert records[0]["title"] == "a b" and records[0]["publishedAt"] == "2024-01-01T09:00:00"
    assert (records[0]["sentimentScore"], records[0]["sentimentLabel"]) == (0.0, "neutral")
    assert records[1]["sentimentLabel"] == "positive" and records[1]["isRepresentative"] is True
    assert records[0]["summary"] == "가나 다라. 가나 둘. 셋."

    events = settle(spark.createDataFrame([(DAY, -0.7)], "date_only date, change double"), "t")
    event = json.loads(payloads.as_json(payloads.event_payload(articles, events, "X", "id")).first()[0])
    assert event == {
        "stockCode": "X", "eventDate": "2024-01-01", "eventType": fixed.PLUNGE, "changeRate": -0.7,
        "keyword": "가나, 다라", "summary": "가나 다라. 가나 둘. 셋.",
    }


def test_price_files_and_join(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("Date,Close\n2024-01-01,100\n2024-01-02,110\n2024-01-04,121\n2024-02-01,1\n")
    prices = price.price_series(files.read_prices(spark, str(path)), end="2024-02-01")
    signal = spark.createDataFrame(
        [(dt.date(2024, 1, n), float(n)) for n in (1, 2, 3, 4)], "date_only date, sentiment_mean double"
    )
    got = sorted(tuple(r) for r in price.signal_price(signal, prices).collect())
    assert [r[0].day for r in got] == [1, 2, 4]
    assert [r[3] for r in got] == [pytest.approx(0.1), pytest.approx(0.1), None]
    assert [r[4] for r in got] == [None, 1.0, 2.0]


def test_articles_between_read_only_their_days(spark):
    path = scratch_path(spark, "days")
    rows = [(f"u{n}", dt.date(2024, 1, n)) for n in range(1, 10)]
    sinks.write_table(spark.createDataFrame(rows, "url string, date_only date"), path, partition_by="date_only")
    found = files.read_articles_between(spark, path, "2024-01-03", "2024-01-05")
    assert sorted(r["url"] for r in found.collect()) == ["u3", "u4", "u5"]
    assert "PartitionFilters: [isnotnull(date_only" in found._jdf.queryExecution().toString()


def test_projection_and_relevance(spark):
    rows = [("삼각형", "x", "d", "p", "u1"), ("other", "본문 삼각형", "d", "p", "u2"), (None, None, "d", "p", "u3")]
    df = spark.createDataFrame(rows, schemas.ARTICLE_RAW)
    assert jdbc.project(df, ["url", "title"]).columns == ["url", "title"]
    assert [r["url"] for r in pages.relevant(df, ["삼각형"]).collect()] == ["u1"]
    assert [r["url"] for r in pages.relevant(df, ["삼각형"], body_prefix=300).collect()] == ["u1", "u2"]
    with pytest.raises(ValueError):
        pages.relevant(df, [])
    titles = [r[0] for r in df.select(pages.title_or_placeholder("title")).collect()]
    assert titles == ["삼각형", "other", fixed.MISSING_TITLE]


def test_polling_form_of_the_stop_rule(spark):
    """Five pages; the first page without a new link ends the listing."""
    rows = [(0, 0, 0, "https://x/a"), (0, 1, 0, "https://x/a"), (0, 2, 0, "https://x/b"), (1, 0, 0, "https://x/c")]
    df = spark.createDataFrame(rows, "month long, page long, pos long, url string")
    got = {
        r["month"]: (r["pages_visited"], r["stop_reason"])
        for r in frontier.page_stop_rule(df, pages=5, empty_limit=1, last_free_page=-1).collect()
    }
    assert got == {0: (2, "nothing_new"), 1: (2, "empty_pages")}


def test_headlines_of_a_hot_day(spark):
    articles = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("date").alias("date_only"),
        F.concat(F.lit("t"), "id").alias("title"), F.lit("neutral").alias("final_sentiment"),
        ((F.col("id") % 100) / 100).alias("confidence"), F.format_string("u%05d", "id").alias("url"),
    ).repartition(9)
    events = spark.createDataFrame([(DAY,)], "date_only date")
    got = [(r["rank"], r["title"]) for r in daily.event_news(articles, events).orderBy("rank").collect()]
    best = [i for i in range(5000) if i % 3 and i % 100 == 99][:3]
    assert got == [(n + 1, f"t{i}") for n, i in enumerate(best)]


def test_relevance_in_a_whole_body(spark):
    """A keyword behind the first 300 characters of a body counts as well."""
    df = spark.createDataFrame([("u1", "t", "x" * 400 + "key"), ("u2", "key", None), ("u3", "t", "none")], "url string, title string, content string")
    assert [r["url"] for r in pages.relevant(df, ["key"], whole_body=True).collect()] == ["u1", "u2"]
    assert [r["url"] for r in pages.relevant(df, ["key"], body_prefix=300).collect()] == ["u2"]


def test_relevance_query_finds_words_of_bodies(spark):
    found = catalog.QUERIES["relevance_filter"](spark, "/root/testdata/sf0.001")
    assert found.where("NOT in_title").count() > 0


def test_reject_reasons_query_meets_both_reasons(spark):
    found = {r.reason for r in catalog.QUERIES["reject_reasons"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {fixed.REASON_NO_BODY, fixed.REASON_SHORT_BODY}
