"""Stored tables by day and by bucket, database ranges, routes and rounds."""

import random
import uuid

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from newspulse.operators import frontier, keyed, pages
from newspulse.session import scratch_path
from newspulse.sources import jdbc


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- Days -----------------------------------------------------------------------


def files_by_day(spark, path):
    rows = spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), F.col("_metadata.file_name").alias("f")).distinct().collect()
    out = {}
    for r in rows:
        out.setdefault(r.day, set()).add(r.f)
    return out


def test_only_days_with_a_changed_key_are_written(spark):
    path = scratch_path(spark, "days")
    rows = [(i, f"t{i}", None if i % 5 == 4 else f"2024-01-0{1 + i % 5}", "old") for i in range(50)]
    table = spark.createDataFrame(rows, "id long, title string, day string, label string")
    table.write.partitionBy("day").parquet(path)
    before = files_by_day(spark, path)
    changes = spark.createDataFrame([(1, "x", 0.5), (6, "y", None), (6, "z", 0.7), (99, "no", 1.0), (None, "n", 1.0)], "id long, label string, score double")
    got = keyed.update_days(spark, path, table.schema, changes, "id", ["label", "score"], [F.col("label")], day="day")
    after = files_by_day(spark, path)
    assert {d for d in before if before[d] != after[d]} == {"2024-01-02"}
    want = {i: ("x", 0.5) if i == 1 else ("y", None) if i == 6 else ("old", None) for i in range(50)}
    assert {r.id: (r.label, r.score) for r in got.collect()} == want
    assert {r.id: (r.title, r.day) for r in got.collect()} == {r[0]: (r[1], r[2]) for r in rows}
    # The day may come with the change; a missing day is a day.
    later = spark.createDataFrame([(4, "w", 0.1, None)], "id long, label string, score double, day string")
    again = keyed.update_days(spark, path, got.schema, later, "id", ["label", "score"], day="day")
    last = files_by_day(spark, path)
    assert {d for d in after if after[d] != last[d]} == {None}
    assert {r.id: (r.label, r.score) for r in again.collect()} == want | {4: ("w", 0.1)}
    none = keyed.update_days(spark, path, got.schema, later.limit(0), "id", ["label", "score"], day="day")
    assert none.count() == 50 and files_by_day(spark, path) == last


# --- Buckets ----------------------------------------------------------------------


def test_a_keyed_table_is_not_shuffled(spark):
    name, path = f"t_{uuid.uuid4().hex}", scratch_path(spark, "buckets")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    stored = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("n"), F.lit("old").alias("v"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed.create_table(stored, name, path, "url", buckets)
    batch = spark.createDataFrame([("u1", 5, "new"), ("u1", 4, "newer"), ("x", 1, "new"), (None, 2, "new"), (None, 1, "new")], "url string, n long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unknown = keyed.unknown_rows(batch, name, [F.col("n")])
        plan = plan_of(unknown)  # one exchange, that of the batch
        assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Bucketed: true") and "SortMergeJoin" in plan
        assert sorted(unknown.collect(), key=str) == sorted([("x", 1, "new"), (None, 1, "new")], key=str)
        keyed.append_batch(batch, 1, name, path, "url", buckets)
        now = keyed.current(spark, name, [F.col("n")])
        assert "Exchange" not in plan_of(now)
        got = {r.url: (r.n, r.v) for r in now.collect()}
        assert len(got) == 2002 and got["u1"] == (4, "newer") and got[None] == (1, "new") and got["u2"] == (2, "old")
        assert keyed.unknown_rows(batch, name, [F.col("n")]).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE {name}")


# --- Database ranges ---------------------------------------------------------------


def ranges_of(keys, partitions, fine=16):
    con = duckdb.connect()
    news = pd.DataFrame({"ID": pd.array(keys, "Int64")})
    con.register("news", news)
    asked = []

    def count(lo, hi, width):
        asked.append((lo, hi, width))
        return [(int(k), n) for k, n in con.execute(jdbc.histogram_sql("news", "ID", lo, hi, width)).fetchall()]

    known = [k for k in keys if k is not None]
    bounds = jdbc.equal_depth(count, min(known), max(known) + 1, partitions, fine)
    conditions = jdbc.predicates("ID", bounds)
    sizes = [con.execute(f"SELECT COUNT(*) FROM news WHERE {c}").fetchone()[0] for c in conditions]
    assert sum(sizes) == len(keys) and len(sizes) <= partitions
    return sizes, asked


def test_dense_ranges_are_split_by_rows():
    rng = random.Random(3)
    dense = [10**9 + k for k in range(20_000)] + rng.sample(range(10**12), 2_000)
    sizes, asked = ranges_of(dense, 8)
    assert max(sizes) < 1.2 * len(dense) / 8 and len(asked) < 200
    even, asked = ranges_of(list(range(5_000)), 8)
    assert max(even) - min(even) <= 2 * 5_000 / 8 / 16 and len(even) == 8
    assert sum(ranges_of([7] * 50 + [None], 8)[0]) == 51
    hot, _ = ranges_of([5] * 900 + list(range(100)), 4)
    assert sum(hot) == 1_000
    assert len(ranges_of([1, 2], 8)[0]) <= 8
    assert jdbc.predicates("ID", [0, 10]) == ["1 = 1"]
    assert "COUNT(*)" in jdbc.histogram_sql("NEWS", "ID", 0, 10, 2)


# --- Pages --------------------------------------------------------------------------

BODY = "<article>" + "<p>word word word word.</p>" * 5 + "</article>"
PAGES = [(1, "https://h.example/1", "<h1>Fine title</h1>" + BODY), (2, "https://h.example/2", "<p>nothing</p>"), (3, "https://h.example/3", None),
         (4, "https://h.example/4", "<article>thirty five characters are in this text</article>")]


def test_both_outputs_come_from_one_scan(spark):
    path = scratch_path(spark, "route-in")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "route")
    found = pages.route(pages.extract_articles(spark.read.parquet(path)), scratch_path(spark, "route-out"))
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup(uuid.uuid4().hex, "after")
    assert len(jobs) == 2  # the footer of the input, and the one pass
    assert found.counts == {"accepted": 1, "본문 없음": 2, "본문 짧음": 1}
    assert [r.page_id for r in found.accepted.collect()] == [1] and "reason" not in found.accepted.columns
    assert {tuple(r) for r in pages.count_reasons(found.rejected).collect()} == {("본문 없음", 2), ("본문 짧음", 1)}
    assert "route-in" not in plan_of(found.accepted) + plan_of(found.rejected)


def containers(spark, page, **more):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    found = pages.link_containers(df, **more)
    assert not any(x in plan_of(found) for x in ("Python", "Pandas", "Arrow"))
    return [tuple(r)[1:] for r in found.orderBy("pos").collect()]


def test_containers_with_unclosed_and_crossed_tags(spark):
    crossed = '<div class="a"><li class="b">x<a href=1>l</a></div>y</li><div class="c">z</div>'
    assert containers(spark, crossed) == [(0, "div", "a", "xl"), (1, "li", "b", "xl")]
    unclosed = 'before<DIV CLASS=\'big one\'>t &amp; u<li class=q><a>v'
    assert containers(spark, unclosed) == [(0, "div", "big one", "t & uv"), (1, "li", "q", "v")]
    assert containers(spark, '</div><div>no class<a></a></div><br></li>', need_class=False) == [(0, "div", "", "no class")]
    assert containers(spark, '</div><div>no class<a></a></div>') == []
    odd = '<div class="x" title="a > b"><!-- <a>hidden</a> -->s<script>"<a>"</script></div><div/><li class="y"/>w<a>'
    assert containers(spark, odd, need_class=False) == []
    assert containers(spark, None) == containers(spark, "") == containers(spark, "<<<>>") == []
    deep = '<div class="d">' * 300 + "<a>text</a>"
    assert len(containers(spark, deep)) == 300


# --- Stop rule ----------------------------------------------------------------------


def walk(rows, months, pages_, empty_limit=3, last_free=5):
    """The months one after the other, as a crawler goes."""
    seen, out = set(), {}
    for m in months:
        empty = visited = new = 0
        why = "page_limit"
        for p in range(pages_):
            urls = {u for a, b, u in rows if (a, b) == (m, p)}
            visited += 1
            empty = 0 if urls else empty + 1
            if empty >= empty_limit:
                why = "empty_pages"
                break
            fresh = urls - seen
            seen |= fresh
            new += len(fresh)
            if urls and not fresh and p > last_free:
                why = "nothing_new"
                break
        out[m] = (visited, new, why)
    return out


def test_rounds_look_at_fewer_rows_and_agree_with_a_walk(spark):
    rng = random.Random(8)
    shrank = 0
    for trial in range(4):
        rows = {(m, p, rng.randint(0, 40 + 60 * trial)) for m in range(8) for p in range(12) for _ in range(rng.randint(0, 3))}
        df = spark.createDataFrame([(m, p, 0, f"https://x/{u}") for m, p, u in rows], "month long, page long, pos long, url string")
        plan = spark.createDataFrame([(m, p) for m in range(9) for p in range(12)], "month long, page long")
        handled = []
        got = {r.month: tuple(r)[1:] for r in frontier.page_stop_rule(df, plan=plan, handled=handled).collect()}
        assert got == walk(rows, range(9), 12)
        assert all(n <= handled[0] for n in handled)
        shrank += sum(n < handled[0] for n in handled[1:])
    assert shrank > 0
