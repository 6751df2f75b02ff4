"""Streams: same rows as a batch run, after restarts, replays and late rows."""

import pytest
from pyspark.sql import functions as F

from newspulse.operators import daily
from newspulse.session import scratch_path
from newspulse.streaming import jobs, store

ARTICLE = "title string, content string, date string, press string, url string"


def article(n, day, title, url=None):
    return (title, f"Body {n}. More.", day, "p", url or f"https://x/{n}")


def settings(**more):
    return jobs.RefreshSettings(
        ["good"], ["bad"], lookback_days=None, threshold=0.5, min_count=2, **more
    )


def run(spark, path, rows, s):
    spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = jobs.article_stream(spark, f"{path}/in", ARTICLE)
    jobs.refresh(stream, path, f"{path}/checkpoint", s, once=True).awaitTermination()


def out(spark, path, name):
    return sorted(tuple(r) for r in jobs.published(spark, path, name).collect())


def test_refresh_in_steps_equals_one_refresh(spark):
    rows = [article(i, f"2024-01-0{1 + i % 4} 10:00:00", ["good news", "bad news", "plain"][(i % 4) % 3]) for i in range(40)]
    rows += [article(99, "3 hours ago", "good"), article(98, None, "bad")]
    steps, whole = scratch_path(spark, "steps"), scratch_path(spark, "whole")
    for part in (rows[:15], rows[10:30], rows[30:], rows[:5]):
        run(spark, steps, part, settings())
    run(spark, whole, rows, settings())
    for name in ("daily", "events", "event_news"):
        assert out(spark, steps, name) == out(spark, whole, name) != []
    schema = "url string"
    assert store.read_store(spark, f"{steps}/articles", schema).count() == 42


def test_replayed_batch_overwrites_itself(spark):
    path = scratch_path(spark, "replay")
    batch = spark.createDataFrame([(1,), (2,)], "k long")
    store.write_batch(batch, path, 0)
    store.write_batch(batch, path, 1)
    store.write_batch(batch, path, 1)
    assert store.read_store(spark, path, "k long").count() == 4
    assert store.read_store(spark, path, "k long", before=1).count() == 2


def test_used_store_needs_its_checkpoint(spark):
    path = scratch_path(spark, "guard")
    run(spark, path, [article(1, "2024-01-01 10:00:00", "good")], settings())
    stream = jobs.article_stream(spark, f"{path}/in", ARTICLE)
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.refresh(stream, path, f"{path}/other", settings(), once=True)


def test_lookback_cuts_inside_the_first_day(spark):
    path = scratch_path(spark, "lookback")
    s = settings()
    s.lookback_days, s.as_of = 1, "2024-01-03 12:00:00"
    rows = [article(i, f"2024-01-0{d} {h}:00:00", "good") for i, (d, h) in enumerate(
        [(1, "20"), (1, "21"), (2, "11"), (2, "12"), (2, "13"), (2, "14"), (3, "01"), (3, "02"), (3, "03")])]
    run(spark, path, rows, s)
    assert [(str(r[0]), r[2]) for r in out(spark, path, "daily")] == [("2024-01-02", 2), ("2024-01-03", 3)]


def test_late_rows_inside_the_delay_count(spark):
    path = scratch_path(spark, "late")
    schema = "ts timestamp, value long"
    for rows in ([("2024-02-20", 1)], [("2024-01-25", 3)], [("2024-01-25", 5), ("2023-01-01", 9)]):
        df = spark.createDataFrame(rows, "t string, value long").select(F.col("t").cast("timestamp").alias("ts"), "value")
        df.write.mode("append").parquet(f"{path}/in")
        stream = jobs.daily_windows(jobs.article_stream(spark, f"{path}/in", schema), "ts", "value")
        jobs.write_daily(stream, f"{path}/log", f"{path}/checkpoint", once=True).awaitTermination()
    got = sorted((str(r[0]), r[1], r[2]) for r in jobs.latest_daily(spark, f"{path}/log").collect())
    assert got == [("2024-01-25", 4.0, 2), ("2024-02-20", 1.0, 1)]


def test_bounded_dedup(spark):
    path = scratch_path(spark, "bounded")
    df = spark.createDataFrame([("2024-01-01", "u"), ("2024-01-02", "u"), ("2024-01-02", "v")], "t string, url string")
    df.select(F.col("t").cast("timestamp").alias("ts"), "url").write.parquet(f"{path}/in")
    stream = jobs.dedup_within_watermark(jobs.article_stream(spark, f"{path}/in", "ts timestamp, url string"), "ts", "url")
    jobs.ingest(stream, f"{path}/rows", f"{path}/checkpoint", once=True).awaitTermination()
    assert spark.read.parquet(f"{path}/rows").count() == 2


def test_refresh_daily_equals_the_batch_operator(spark):
    path = scratch_path(spark, "batch")
    rows = [article(i, f"2024-01-0{1 + i % 3} 10:00:00", ["good", "bad", "x", "good good"][i % 4]) for i in range(24)]
    run(spark, path, rows, settings(lexicon_correction=True))
    scored = jobs.score_batch(spark.createDataFrame(rows, ARTICLE), settings(lexicon_correction=True))
    want = daily.with_change(daily.daily_sentiment(scored, min_count=2))
    assert out(spark, path, "daily") == sorted(tuple(r) for r in want.collect())


def test_supervised_job_goes_on_after_an_error(spark):
    path = scratch_path(spark, "supervised")
    spark.range(5).selectExpr("id AS k").write.parquet(f"{path}/in")
    calls = []

    def work(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("first try fails")
        store.write_batch(batch, f"{path}/store", batch_id)

    def start():
        return jobs.start(jobs.article_stream(spark, f"{path}/in", "k long"), work, f"{path}/checkpoint", once=True)

    assert jobs.supervise(start, pause=0.0) == 1
    assert calls == [0, 0]
    assert store.read_store(spark, f"{path}/store", "k long").count() == 5
    with pytest.raises(Exception, match="always"):
        spark.range(1).selectExpr("id AS k").write.mode("append").parquet(f"{path}/in")

        def fails(batch, batch_id):
            raise RuntimeError("always")

        jobs.supervise(
            lambda: jobs.start(jobs.article_stream(spark, f"{path}/in", "k long"), fails, f"{path}/checkpoint", once=True),
            pause=0.0, max_failures=2,
        )


def test_rewritten_store_holds_the_same_rows(spark):
    path = scratch_path(spark, "rewrite")
    for i in range(3):
        store.write_batch(spark.range(i, i + 2).selectExpr("id AS k", "DATE'2024-01-01' AS date_only"), f"{path}/a", i, "date_only")
    store.rewrite_store(spark, f"{path}/a", f"{path}/b", "k long, date_only date", 1, "date_only")
    assert sorted(r[0] for r in store.read_store(spark, f"{path}/b", "k long, date_only date").collect()) == [0, 1, 1, 2]


def test_refresh_goes_on_after_a_rewrite(spark):
    rows = [article(i, f"2024-01-0{1 + i % 4} 10:00:00", ["good", "bad", "x"][(i % 4) % 3]) for i in range(24)]
    old, new, whole = scratch_path(spark, "old"), scratch_path(spark, "new"), scratch_path(spark, "all")
    run(spark, old, rows[:10], settings())
    run(spark, old, rows[8:16], settings())
    jobs.rewrite_refresh_store(spark, old, new, jobs.stored_schema(spark, ARTICLE, settings()), 1)
    spark.createDataFrame(rows[12:], ARTICLE).coalesce(1).write.mode("append").parquet(f"{old}/in")
    stream = jobs.article_stream(spark, f"{old}/in", ARTICLE)
    jobs.refresh(stream, new, f"{old}/checkpoint", settings(), once=True).awaitTermination()
    run(spark, whole, rows, settings())
    for name in ("daily", "events", "event_news"):
        assert out(spark, new, name) == out(spark, whole, name) != []


def deliver(spark, path, rows):
    spark.createDataFrame(rows, "url string, n long").coalesce(1).write.mode("append").parquet(f"{path}/in")


def new_rows(spark, path):
    return jobs.article_stream(spark, f"{path}/in", "url string, n long", files_per_batch=1)


def test_known_keys_are_state_of_the_stream(spark):
    path = scratch_path(spark, "state")
    for rows in ([("a", 1), ("b", 2), (None, 3), ("", 4)], [("b", 5), ("c", 6), (None, 7), ("", 8)], [("a", 9)], [("d", 10), ("d", 10)]):
        deliver(spark, path, rows)
        query = jobs.ingest_new(new_rows(spark, path), f"{path}/store", f"{path}/checkpoint", once=True)
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "StreamingDeduplicate" in plan
    stored = store.read_store(spark, f"{path}/store", "url string, n long").collect()
    assert sorted(stored, key=lambda r: r.n) == [("a", 1), ("b", 2), (None, 3), ("", 4), ("c", 6), ("d", 10)]
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    assert sorted(r[0] or "" for r in state.select("key.url").collect()) == ["", "", "a", "b", "c", "d"]


def test_a_batch_that_fails_half_way_is_run_again(spark):
    path = scratch_path(spark, "again")
    deliver(spark, path, [("a", 1), ("b", 2)])
    jobs.ingest_new(new_rows(spark, path), f"{path}/store", f"{path}/checkpoint", once=True).awaitTermination()
    deliver(spark, path, [("b", 3), ("c", 4)])
    seen = []

    def work(batch, batch_id):
        store.write_batch(batch, f"{path}/store", batch_id)
        seen.append(batch_id)
        if len(seen) == 1:
            raise RuntimeError("after the write, before the commit")

    def start():
        return jobs.start(jobs.first_seen(new_rows(spark, path)), work, f"{path}/checkpoint", once=True)

    assert jobs.supervise(start, pause=0.0) == 1 and seen == [1, 1]
    rows = store.read_store(spark, f"{path}/store", "url string, n long").collect()
    assert sorted(rows) == [("a", 1), ("b", 2), ("c", 4)]


def test_a_batch_saves_only_what_it_adds(spark):
    """Bytes that a batch leaves in the checkpoint don't grow with the keys already known."""
    path = scratch_path(spark, "growth")
    import pathlib

    root = pathlib.Path(f"{path}/checkpoint/state".removeprefix("file:"))
    sizes, before = [], 0
    for rows in ([(f"https://example.com/{i}", i) for i in range(20_000)], [("x", 1)], [("y", 2)]):
        deliver(spark, path, rows)
        jobs.ingest_new(new_rows(spark, path), f"{path}/store", f"{path}/checkpoint", once=True).awaitTermination()
        now = sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
        sizes.append(now - before)
        before = now
    assert max(sizes[1:]) < 0.2 * sizes[0], sizes


def test_a_refresh_writes_few_files_a_day(spark):
    """Every task wrote a file for every day, as a micro-batch knows no rebalance."""
    path = scratch_path(spark, "files")
    import pathlib

    run(spark, path, [article(i, f"2024-01-{1 + i % 10:02d} 10:00:00", "good") for i in range(400)], settings())
    days = [d for d in pathlib.Path(f"{path}/articles/batch=0".removeprefix("file:")).iterdir() if d.is_dir()]
    assert len(days) == 10 and [len(list(d.glob("*.parquet"))) for d in days] == [1] * 10
