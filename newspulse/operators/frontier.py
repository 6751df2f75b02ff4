"""Collection plan and link frontier: calendar, first-seen links, stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from newspulse.functions import fixed, urls
from newspulse.functions.dates import dotted
from newspulse.operators.ranking import first_per_key, running_totals
from newspulse.session import settle


def month_ranges(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Months touched by each [start, end] span, clipped at both ends."""
    months = spans.select(
        start, end,
        F.explode(F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("INTERVAL 1 MONTH"))).alias("_month"),
    )
    return months.select(
        dotted(F.greatest("_month", start)).alias("ds"), dotted(F.least(F.last_day("_month"), end)).alias("de")
    )


def page_plan(
    ranges: DataFrame,
    pages: int = fixed.PAGES_PER_MONTH,
    first_offset: int = 1,
    step: int = fixed.RESULTS_PER_PAGE,
) -> DataFrame:
    """Every page to list for every range, with its result offset."""
    numbered = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    return numbered.withColumn("offset", first_offset + F.col("page") * step)


def first_seen(listing: DataFrame, order: list[str], contains: str | None = None, url: str = "url") -> DataFrame:
    """Accepted links, one row per normalised url: the first in listing order."""
    links = listing.where(urls.accepted(url, contains)).withColumn("norm_url", urls.normalise(url))
    return first_per_key(links, ["norm_url"], [F.asc(c) for c in order])


def page_stop_rule(
    listing: DataFrame,
    pages: int = fixed.PAGES_PER_MONTH,
    empty_limit: int = fixed.EMPTY_PAGE_LIMIT,
    last_free_page: int = fixed.LAST_PAGE_WITHOUT_STOP,
    contains: str | None = None,
    url: str = "url",
    plan: DataFrame | None = None,
    stored: DataFrame | None = None,
    handled: list[int] | None = None,
) -> DataFrame:
    """Where the listing of each month stops, and why; months are visited in order.

    A month stops on the ``empty_limit``-th empty page in a row, or on a page
    past ``last_free_page`` that has items but adds no url. A url is new where
    it is first seen on a visited page; one on a page that was not visited is
    new to the next month that lists it, and one of ``stored`` (column
    ``url``) is never new. ``plan`` (month, page) names the pages to visit,
    months without any listed item included; without it they are the first
    ``pages`` of the months that occur in ``listing``.

    The empty pages don't depend on urls. Whether a page adds any depends on
    where earlier months stopped, so the second stop is found in rounds: each
    settles at least the first month whose stop was not final. After the
    first round only urls on pages that a moved stop has added or taken away
    are looked at, and the counts of added urls change by their difference.
    ``handled`` gets the number of (url, month) rows of every round.
    """
    if plan is None:
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))
        plan = listing.select("month").distinct().select("month", numbers.alias("page"))
    plan = plan.select(F.col("month"), F.col("page").cast("long").alias("page")).distinct()
    items = listing.groupBy("month", "page").agg(F.count(F.lit(1)).alias("items"))
    grid = plan.join(items, ["month", "page"], "left").na.fill(0, ["items"])
    so_far = Window.partitionBy("month").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.max(F.when(F.col("items") > 0, F.col("page"))).over(so_far), F.lit(-1))
    month = Window.partitionBy("month")
    empty = F.min(F.when(F.col("page") - before >= empty_limit, F.col("page"))).over(month)
    grid = grid.withColumn("empty_stop", empty).where(F.col("empty_stop").isNull() | (F.col("page") <= F.col("empty_stop")))
    grid = settle(grid, "frontier-grid")
    links = listing.where(urls.accepted(url, contains)).select("month", "page", urls.normalise(url).alias("u"))
    firsts = links.join(grid.select("month", "page"), ["month", "page"], "left_semi").groupBy("u", "month").agg(F.min("page").alias("page"))
    if stored is not None:
        firsts = firsts.join(stored.select(urls.normalise("url").alias("u")), "u", "left_anti")
    firsts = settle(firsts, "frontier-urls")
    # One row a month; read again from the settled pages where it is needed.
    stops = grid.groupBy("month").agg(F.max("page").alias("stop"))
    earlier = Window.partitionBy("u").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)

    def is_new(stop: str) -> Column:
        return (F.coalesce(F.max((F.col("page") <= F.col(stop)).cast("int")).over(earlier), F.lit(0)) == 0).cast("long")

    def with_stop(counts: DataFrame, rows: DataFrame, change: Column, name: str) -> DataFrame:
        """The grid with changed counts and where months then stop; notes how many rows that took."""
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        delta = watched.withColumn("d", change).groupBy("month", "page").agg(F.sum("d").alias("d"))
        full = counts.join(delta, ["month", "page"], "left").withColumn("added", F.col("added") + F.coalesce("d", F.lit(0))).drop("d")
        stale = F.min(F.when((F.col("items") > 0) & (F.col("added") == 0) & (F.col("page") > last_free_page), F.col("page")))
        out = settle(full.withColumn("stale_stop", stale.over(month)), name)
        if handled is not None:
            handled.append(seen.get["n"])
        return out

    found = with_stop(grid.withColumn("added", F.lit(0).cast("long")), firsts.join(stops, "month"), is_new("stop"), "frontier-round")
    while True:
        last = found.groupBy("month").agg(F.coalesce(F.min("stale_stop"), F.max("page")).alias("stop"))
        both = last.join(stops.withColumnRenamed("stop", "old"), "month").select("month", "old", "stop")
        moved = both.where("stop <> old")
        if moved.isEmpty():
            break
        between = (F.col("page") > F.least("old", "stop")) & (F.col("page") <= F.greatest("old", "stop"))
        touched = firsts.join(moved, "month").where(between).select("u").distinct()
        rows = firsts.join(touched, "u", "left_semi").join(both, "month")
        found = with_stop(found.drop("stale_stop"), rows, is_new("stop") - is_new("old"), "frontier-round")
        stops = last
    visited = found.where(F.col("stale_stop").isNull() | (F.col("page") <= F.col("stale_stop")))
    why = F.when(F.max("stale_stop").isNotNull(), "nothing_new").when(F.max("empty_stop").isNotNull(), "empty_pages")
    return visited.groupBy("month").agg(
        F.count(F.lit(1)).alias("pages_visited"),
        F.sum("added").alias("new_urls"),
        F.coalesce(why, F.lit("page_limit")).alias("stop_reason"),
    )


def frontier_progress(
    listing: DataFrame,
    target: int = fixed.TARGET_ARTICLES,
    factor: float = fixed.TARGET_FACTOR,
    **rule,
) -> DataFrame:
    """New urls of the visited pages per month and their running total, up to
    the month that reaches ``factor`` times the target. ``rule`` goes to
    ``page_stop_rule``."""
    per_month = page_stop_rule(listing, **rule).select("month", "new_urls")
    progress = running_totals(per_month, "month", {"new_urls": "total_urls"})
    return progress.where(F.col("total_urls") - F.col("new_urls") < target * factor)


def candidate_cap(links: DataFrame, remaining: int, order: list[Column]) -> DataFrame:
    """The first ``2 * remaining`` links: the collection's candidate list."""
    return links.orderBy(*order).limit(2 * remaining)
