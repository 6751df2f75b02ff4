"""Queries over the collection plan and the link frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.operators import frontier as ops
from newspulse.plans import fixtures as fx
from newspulse.plans.registry import query

MONTHS_SQL = """span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
 months AS (SELECT a, b, CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m FROM span),
 ranges AS (SELECT strftime(greatest(m, a), '%Y.%m.%d') AS ds, strftime(least(last_day(m), b), '%Y.%m.%d') AS de FROM months)"""
FIRST_SQL = f"""{fx.LISTING_SQL}, ranked AS (
  SELECT *, rtrim(split_part(url, '?', 1), '/') AS norm_url,
         row_number() OVER (PARTITION BY rtrim(split_part(url, '?', 1), '/') ORDER BY month, page, pos) AS r FROM listing)"""


def _span(spark, sf):
    day = F.to_date("o_orderdate")
    return fx.table(spark, sf, "orders").agg(F.min(day).alias("start"), F.max(day).alias("end"))


@query("month_ranges", f"WITH {MONTHS_SQL} SELECT ds, de FROM ranges")
def month_ranges(spark, sf):
    return ops.month_ranges(_span(spark, sf))


@query(
    "page_plan",
    f"""WITH {MONTHS_SQL}, recent AS (SELECT strftime(b - INTERVAL 1 DAY, '%Y.%m.%d') AS ds, strftime(b, '%Y.%m.%d') AS de FROM span)
 SELECT 'history' AS kind, ds, de, page, 1 + 10 * page AS "offset" FROM ranges, range(40) p(page)
 UNION ALL SELECT 'realtime', ds, de, page, 10 * page FROM recent, range(5) p(page)""",
)
def page_plan(spark, sf):
    span = _span(spark, sf)
    history = ops.page_plan(ops.month_ranges(span))
    recent = span.select(
        F.date_format(F.date_sub("end", 1), "yyyy.MM.dd").alias("ds"), F.date_format("end", "yyyy.MM.dd").alias("de")
    )
    realtime = ops.page_plan(recent, pages=5, first_offset=0)
    return history.select(F.lit("history").alias("kind"), "*").unionByName(
        realtime.select(F.lit("realtime").alias("kind"), "*")
    )


@query("frontier_dedup", f"WITH {FIRST_SQL} SELECT month, page, pos, url, norm_url FROM ranked WHERE r = 1")
def frontier_dedup(spark, sf):
    return ops.first_seen(fx.listing(spark, sf), ["month", "page", "pos"], contains="news.example/a/")


# The months one after the other, with the urls seen so far; a last month of the plan has no hit.
STOP_SQL = f"""RECURSIVE {fx.LISTING_SQL}, hits AS (SELECT month, page, rtrim(split_part(url, '?', 1), '/') AS u FROM listing),
 grid AS (SELECT m.month, p.page, count(u) AS items FROM (SELECT DISTINCT month FROM listing UNION ALL SELECT max(month) + 1 FROM listing) m CROSS JOIN range(40) p(page)
   LEFT JOIN hits h ON h.month = m.month AND h.page = p.page GROUP BY 1, 2),
 streaks AS (SELECT *, page - coalesce(max(CASE WHEN items > 0 THEN page END) OVER (PARTITION BY month ORDER BY page), -1) AS streak FROM grid),
 stops AS (SELECT month, min(CASE WHEN streak >= 3 THEN page END) AS empty_stop, coalesce(min(CASE WHEN streak >= 3 THEN page END), 39) AS last,
   list(items ORDER BY page) AS items FROM streaks GROUP BY 1),
 firsts AS (SELECT h.month, u, min(page) AS page FROM hits h JOIN stops USING (month) WHERE page <= last GROUP BY 1, 2),
 months AS (SELECT s.month, any_value(empty_stop) AS empty_stop, any_value(s.last) AS last, any_value(items) AS items,
   coalesce(list(struct_pack(u := u, page := page)) FILTER (u IS NOT NULL), []) AS urls, row_number() OVER (ORDER BY s.month) AS n
   FROM stops s LEFT JOIN firsts f ON f.month = s.month GROUP BY s.month),
 walk AS (
   SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS month, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS pages_visited,
     CAST(0 AS BIGINT) AS new_urls, '' AS stop_reason
   UNION ALL
   SELECT n, month, list_concat(seen, list_transform(list_filter(fresh, lambda x: x.page <= stop), lambda x: x.u)), stop + 1,
     len(list_filter(fresh, lambda x: x.page <= stop)),
     CASE WHEN stale IS NOT NULL THEN 'nothing_new' WHEN empty_stop IS NOT NULL THEN 'empty_pages' ELSE 'page_limit' END
   FROM (SELECT *, coalesce(stale, last) AS stop FROM (
     SELECT *, list_filter(range(6, last + 1), lambda p: items[p + 1] > 0 AND NOT list_contains(list_transform(fresh, lambda x: x.page), p))[1] AS stale
     FROM (SELECT m.*, w.seen, list_filter(m.urls, lambda x: NOT list_contains(w.seen, x.u)) AS fresh FROM walk w JOIN months m ON m.n = w.n + 1))))"""


def _visits(spark, sf):
    """The listing, and a plan of its months and one more without hits."""
    listing = fx.listing(spark, sf)
    months = listing.select("month").distinct().unionByName(listing.agg((F.max("month") + 1).alias("month")))
    page = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    return listing, months.select("month", page.alias("page"))


@query("page_stop_rule", f"WITH {STOP_SQL} SELECT month, pages_visited, new_urls, stop_reason FROM walk WHERE n > 0")
def page_stop_rule(spark, sf):
    hits, plan = _visits(spark, sf)
    return ops.page_stop_rule(hits, plan=plan)


@query(
    "frontier_progress",
    f"""WITH {STOP_SQL}, running AS (SELECT month, new_urls, CAST(sum(new_urls) OVER (ORDER BY month) AS BIGINT) AS total_urls FROM walk WHERE n > 0)
 SELECT month, new_urls, total_urls FROM running WHERE total_urls - new_urls < 400 * 1.5""",
)
def frontier_progress(spark, sf):
    hits, plan = _visits(spark, sf)
    return ops.frontier_progress(hits, target=400, plan=plan)


@query(
    "candidate_cap",
    f"WITH {FIRST_SQL} SELECT month, page, pos, norm_url FROM ranked WHERE r = 1 ORDER BY month, page, pos LIMIT 200",
)
def candidate_cap(spark, sf):
    seen = ops.first_seen(fx.listing(spark, sf), ["month", "page", "pos"])
    return ops.candidate_cap(seen, 100, [F.col("month"), F.col("page"), F.col("pos")]).select(
        "month", "page", "pos", "norm_url"
    )
