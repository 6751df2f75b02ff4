"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.functions import fixed, html, text
from newspulse.operators import pages as ops
from newspulse.plans import fixtures as fx
from newspulse.plans.q_text import STRIP, lines_sql, strip_boilerplate_sql
from newspulse.plans.registry import query
from newspulse.session import scratch_path

SITE_NAMES = ["Example News"]


def _pages(spark, sf):
    return fx.dealt(spark, sf, "pages")


def _unescape_sql(c: str) -> str:
    """The references that occur in the test pages."""
    for name, char in {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&amp;": "&"}.items():
        c = f"replace({c}, '{name}', '{char}')"
    return c


def _joined_sql(c: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({c}, '<[^>]+>'), lambda p: {STRIP(_unescape_sql('p'))})"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), '')"


VISIBLE_SQL = """visible AS (SELECT page_id, url, regexp_replace(html,
  '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)', '', 'g') AS html FROM pages)"""
BODY_SQL = f"""{VISIBLE_SQL}, bodies AS (
  SELECT page_id, url, html, regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1) AS inner_ FROM visible),
 parts AS (
  SELECT page_id, url, html,
    {STRIP(_joined_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} AS title,
    CASE WHEN length({_joined_sql('inner_')}) > 30
         THEN {lines_sql(_unescape_sql("regexp_replace(inner_, '<[^>]+>', chr(10), 'g')"))} END AS body
  FROM bodies)"""


@query("page_title", f"WITH {BODY_SQL} SELECT page_id, title FROM parts")
def page_title(spark, sf):
    return _pages(spark, sf).select(
        "page_id", html.page_title(html.visible_html("html"), site_names=SITE_NAMES).alias("title")
    )


@query("page_body", f"WITH {BODY_SQL} SELECT page_id, body FROM parts")
def page_body(spark, sf):
    return _pages(spark, sf).select("page_id", html.page_body(html.visible_html("html")).alias("body"))


@query(
    "page_date",
    f"""WITH {fx.DATED_PAGES_SQL} SELECT page_id,
  CASE c WHEN 0 THEN day || ' 08:00:00' WHEN 1 THEN day || 'T09:00:00' WHEN 2 THEN day || ' 10:00'
         WHEN 3 THEN day || '.' END AS date FROM dated""",
)
def page_date(spark, sf):
    return fx.dated_pages(spark, sf).select("page_id", html.page_date("html", F.col("list_date")).alias("date"))


@query(
    "page_publisher",
    f"""WITH {fx.DATED_PAGES_SQL} SELECT page_id,
  CASE c WHEN 3 THEN 'Daily Example' ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END AS press FROM dated""",
)
def page_publisher(spark, sf):
    from newspulse.functions import urls

    return fx.dated_pages(spark, sf).select(
        "page_id", html.page_publisher("html", urls.host("url"), ("div", 'class="top_logo"')).alias("press")
    )


REASON_SQL = f"""{BODY_SQL}, cleaned AS (SELECT *, {strip_boilerplate_sql("coalesce(body, '')")} AS content FROM parts),
 judged AS (SELECT *, CASE WHEN body IS NULL THEN '{fixed.REASON_NO_BODY}'
   WHEN length(content) < 400 THEN '{fixed.REASON_SHORT_BODY}(' || length(content) || '자)' END AS reason FROM cleaned)"""


# All pages of the test tables have a body, so some without one are added.
WITHOUT_BODY_SQL = """shown_pages AS (SELECT page_id, url, html FROM pages
  UNION ALL SELECT page_id, url, '<h1>Only a title ' || page_id || '</h1>' AS html FROM pages WHERE page_id % 9 = 0)"""
ALL_REASONS_SQL = f"""{WITHOUT_BODY_SQL}, {REASON_SQL.replace("AS html FROM pages)", "AS html FROM shown_pages)")}"""


def _and_some_without_body(pages):
    title = F.concat(F.lit("<h1>Only a title "), F.col("page_id").cast("string"), F.lit("</h1>"))
    return pages.unionByName(pages.where(F.col("page_id") % 9 == 0).withColumn("html", title))


def _routed(spark, sf, shown=lambda pages: pages):
    # The test pages are long; a higher limit makes some of them short.
    return ops.route(ops.extract_articles(shown(_pages(spark, sf)), fx.BOILERPLATE, min_body=400), scratch_path(spark, "routed-pages"))


@query(
    "accept_articles",
    f"""WITH {REASON_SQL} SELECT page_id, CASE WHEN title = '' THEN '{fixed.MISSING_TITLE}' ELSE title END AS title, content,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS press, url FROM judged
 WHERE reason IS NULL AND length(title) >= {fixed.MIN_TITLE}""",
)
def accept_articles(spark, sf):
    kept = _routed(spark, sf).accepted.where(F.char_length("title") >= fixed.MIN_TITLE)
    return kept.select("page_id", ops.title_or_placeholder("title").alias("title"), "content", "press", "url")


@query(
    "reject_reasons",
    f"""WITH {ALL_REASONS_SQL} SELECT regexp_replace(reason, '\\(\\d+자\\)$', '') AS reason, count(*) AS n FROM judged
 WHERE reason IS NOT NULL GROUP BY 1""",
)
def reject_reasons(spark, sf):
    """All whole pages, and every ninth once more with its title alone."""
    return ops.count_reasons(_routed(spark, sf, _and_some_without_body).rejected)


@query(
    "routed_counts",
    f"""WITH {REASON_SQL} SELECT count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM judged""",
)
def routed_counts(spark, sf):
    """Counts that the write of both outputs leaves, without reading them."""
    counts = _routed(spark, sf).counts
    accepted = counts.pop("accepted")
    return spark.createDataFrame([(accepted, sum(counts.values()))], "accepted long, rejected long")


@query(
    "relevance_filter",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id, title, contains(title, 'the') AS has_first, contains(title, 'de') AS has_second,
  contains(title, 'the') OR contains(title, 'de') AS in_title FROM news
 WHERE contains(title, 'the') OR contains(title, 'de') OR contains(content, 'the') OR contains(content, 'de')""",
)
def relevance_filter(spark, sf):
    """Titles and whole bodies; ``relevant_titles`` looks at titles alone."""
    found = ops.relevant(fx.news(spark, sf), fx.RELEVANT, whole_body=True)
    has = [F.col("title").contains(word).alias(name) for word, name in zip(fx.RELEVANT, ("has_first", "has_second"), strict=True)]
    in_title = F.col("title").contains("the") | F.col("title").contains("de")
    return found.select("doc_id", "title", *has, in_title.alias("in_title"))


@query(
    "relevant_titles",
    f"WITH {fx.NEWS_SQL} SELECT doc_id, title FROM news WHERE contains(title, 'the') OR contains(title, 'de')",
)
def relevant_titles(spark, sf):
    return ops.relevant(fx.news(spark, sf), fx.RELEVANT).select("doc_id", "title")


LINKS_SQL = f"""{VISIBLE_SQL}, hrefs AS (
  SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1) AS h FROM visible),
 raw AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS nth FROM hrefs),
 resolved AS (
  SELECT page_id, nth, rtrim(split_part(regexp_extract(url, '^(https?://[^/?#]+)', 1) || {_unescape_sql('href')}, '?', 1), '/') AS link
  FROM raw WHERE href LIKE '/%'),
 firsts AS (SELECT page_id, link, min(nth) AS nth FROM resolved GROUP BY 1, 2),
 links AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS pos, link FROM firsts)"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM links")
def page_links(spark, sf):
    return ops.page_links(_pages(spark, sf))


@query(
    "matching_links",
    f"WITH {LINKS_SQL} SELECT page_id, href FROM raw WHERE contains(href, 'the') OR contains(href, 'de')",
)
def matching_links(spark, sf):
    return ops.matching_links(_pages(spark, sf), ["the", "de"])


@query(
    "tag_inventory",
    rf"""WITH {VISIBLE_SQL}, tags AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<(?:div|article|li|a)\b[^>]*>')) AS t FROM visible)
 SELECT regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(t, '\bclass="([^"]*)"', 1) AS class,
        count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM tags GROUP BY 1, 2""",
)
def tag_inventory(spark, sf):
    return ops.tag_inventory(_pages(spark, sf))


@query(
    "link_containers",
    rf"""WITH {VISIBLE_SQL}, items AS (
  SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS t FROM visible),
 placed AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS pos FROM items)
 SELECT page_id, pos, 'li' AS tag, '' AS class, substr({_joined_sql('t')}, 1, 30) AS text FROM placed""",
)
def link_containers(spark, sf):
    return ops.link_containers(_pages(spark, sf), need_class=False)


@query(
    "link_titles",
    rf"""WITH {VISIBLE_SQL}, items AS (
  SELECT page_id, regexp_extract_all(html, '<a\b[^>]*>(.*?)</a>', 1) AS t FROM visible),
 placed AS (SELECT page_id, unnest(t) AS raw, generate_subscripts(t, 1) AS pos FROM items),
 texts AS (SELECT page_id, pos, {_joined_sql('raw')} AS t FROM placed)
 SELECT page_id,
        first(t ORDER BY length(t) DESC, pos) FILTER (regexp_matches(t, '\p{{L}}')) AS longest,
        first(t ORDER BY pos) FILTER (regexp_matches(t, '\p{{L}}') AND length(t) > 10) AS first_long
 FROM texts GROUP BY 1""",
)
def link_titles(spark, sf):
    candidates = html.element_texts(html.visible_html("html"), "a")
    listed = _pages(spark, sf).select("page_id", candidates.alias("c"))
    return listed.select(
        "page_id",
        text.longest(F.filter("c", lambda t: t.rlike(r"\p{L}"))).alias("longest"),
        F.get(F.filter("c", lambda t: text.has_script(t, r"\p{L}")), F.lit(0)).alias("first_long"),
    )
