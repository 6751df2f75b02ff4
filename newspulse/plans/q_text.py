"""Queries over text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.functions import fixed, text, urls
from newspulse.operators import keywords as kw, segment as seg
from newspulse.plans import fixtures as fx
from newspulse.plans.q_daily import COLLAPSE, LEAD, WS_SQL
from newspulse.plans.registry import query

STRIP = lambda c: rf"regexp_replace(regexp_replace({c}, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"
NOT_WS_SQL = WS_SQL.replace("[", "[^", 1)


@query("full_text", f"WITH {fx.NEWS_SQL} SELECT doc_id, title || ' ' || content AS full_text FROM news")
def full_text(spark, sf):
    return fx.news(spark, sf).select("doc_id", text.full_text("title", "content").alias("full_text"))


@query(
    "model_text",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id,
  {STRIP("title || ' ' || title || ' ' || substr(content, 1, 200)")} AS batch_text,
  substr(title || ' ' || title || ' ' || substr(content, 1, 200), 1, 512) AS polling_text,
  title || ' ' || content AS stored_text FROM news""",
)
def model_text(spark, sf):
    return fx.news(spark, sf).select(
        "doc_id",
        text.model_text("title", "content").alias("batch_text"),
        text.model_text("title", "content", limit=fixed.MODEL_TEXT_LIMIT, trim=False).alias("polling_text"),
        text.model_text("title", "content", prefix=None, title_repeats=1, trim=False).alias("stored_text"),
    )


CLEAN_STEPS = [
    (rf"https?://{NOT_WS_SQL}+", ""),
    (rf"{NOT_WS_SQL}+@{NOT_WS_SQL}+", ""),
    (r"<[^>]+>", ""),
    (rf"[^\p{{L}}\p{{N}}_{WS_SQL[1:-1]}]", " "),
]


def _clean_sql(c: str) -> str:
    for pattern, new in CLEAN_STEPS:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    kept = rf"list_filter(string_split({COLLAPSE(c)}, ' '), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+'))"
    return f"array_to_string({kept}, ' ')"


@query("clean_text", f"WITH {fx.NEWS_SQL} SELECT doc_id, {_clean_sql('content')} AS cleaned FROM news")
def clean_text(spark, sf):
    return fx.news(spark, sf).select("doc_id", text.clean_text("content").alias("cleaned"))


@query("lead_summary", f"WITH {fx.NEWS_SQL} SELECT doc_id, {LEAD('content')} AS summary FROM news")
def lead_summary(spark, sf):
    return fx.news(spark, sf).select("doc_id", text.lead_summary("content").alias("summary"))


BREAK_SQL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(c: str) -> str:
    trimmed = f"list_transform(regexp_split_to_array({c}, '{BREAK_SQL}'), lambda x: {STRIP('x')})"
    return f"array_to_string(list_filter({trimmed}, lambda x: x <> ''), chr(10))"


def strip_boilerplate_sql(c: str) -> str:
    c = f"regexp_replace({c}, '(?m)^Released under .*$', '', 'g')"
    c = rf"regexp_replace({c}, '(?m)^.*@.*\.(com|org|net).*$', '', 'g')"
    return lines_sql(c)


@query(
    "strip_boilerplate",
    f"WITH {fx.NEWS_SQL} SELECT doc_id, {strip_boilerplate_sql('content')} AS content FROM news",
)
def strip_boilerplate(spark, sf):
    return fx.news(spark, sf).select("doc_id", text.strip_boilerplate("content", fx.BOILERPLATE).alias("content"))


@query(
    "url_norm",
    """SELECT page_id, url, rtrim(split_part(url, '?', 1), '/') AS norm_url, sha256(url) AS url_hash,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""",
)
def url_norm(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", "url", urls.normalise("url").alias("norm_url"), urls.url_hash("url").alias("url_hash"),
        urls.host("url").alias("host"),
    )


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in fx.STOPWORDS) + ")"


@query(
    "tokens",
    rf"""WITH {fx.TOKENS_SQL}, kept AS (
  SELECT doc_id, list_filter(tokens, lambda w: length(w) >= 3 AND w NOT IN {STOP_SQL}) AS t FROM token_docs)
 SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM kept""",
)
def tokens(spark, sf):
    t = text.tokens(F.lower("content"), fx.WORD, fx.STOPWORDS, min_length=3)
    docs = fx.news(spark, sf).select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(
    "tagged_tokens",
    r"""WITH dictionary AS (
  SELECT word, CASE length(word) % 3 WHEN 0 THEN 'NNG' WHEN 1 THEN 'VV-x' ELSE 'NNP-y' END AS tag FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM benchmark)),
 placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '\p{L}{2,}') AS w FROM documents))
 SELECT doc_id, pos, word FROM placed
 WHERE word IN (SELECT word FROM dictionary WHERE substr(tag, 1, 3) IN ('NNG', 'NNP', 'VV', 'VA'))""",
)
def tagged_tokens(spark, sf):
    found = fx.table(spark, sf, "benchmark").select(F.explode(text.words(F.lower("text"), fx.WORD)).alias("word"))
    size = F.char_length("word") % 3
    dictionary = found.distinct().select(
        "word", F.when(size == 0, "NNG").when(size == 1, "VV-x").otherwise("NNP-y").alias("tag")
    )
    placed = fx.token_docs(spark, sf).select("doc_id", F.posexplode("tokens").alias("pos", "word"))
    return kw.tagged_tokens(placed, dictionary).select("doc_id", "pos", "word")


# A dictionary of the starts of all benchmark words: longer pieces cost less a letter, unknown letters most.
DICTIONARY_SQL = r"""source_words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM benchmark),
 pieces AS (SELECT DISTINCT substr(w, 1, k) AS word FROM (SELECT w, unnest(range(2, length(w) + 1)) AS k FROM source_words)),
 dictionary AS (
  SELECT word, 12 + length(word) % 4 AS cost,
         CASE length(word) % 3 WHEN 0 THEN 'NNG' WHEN 1 THEN 'VV-x' ELSE 'NNP' END AS tag FROM pieces)"""
SEGMENT_SQL = rf"""WITH RECURSIVE {DICTIONARY_SQL},
 runs AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}{{2,}}')) AS run FROM documents),
 starts AS (SELECT run, unnest(range(0, length(run))) AS s FROM runs),
 ways AS MATERIALIZED (
  SELECT run, s, s + length(word) AS e, cost, tag FROM (
    SELECT run, s, unnest(range(2, 1 + least(length(run) - s, (SELECT max(length(word)) FROM dictionary)))) AS n FROM starts)
    JOIN dictionary ON word = substr(run, s + 1, n)
  UNION ALL SELECT run, s, s + 1, {seg.UNKNOWN_COST}, '{seg.UNKNOWN_TAG}' FROM starts),
 best AS (
  SELECT run, 0 AS i, [0] AS costs, [0] AS steps, [0] AS froms, [''] AS tags FROM runs
  UNION ALL
  SELECT run, i + 1, list_append(costs, m.c), list_append(steps, m.n), list_append(froms, m.s), list_append(tags, m.tag) FROM (
    SELECT run, i, any_value(costs) AS costs, any_value(steps) AS steps, any_value(froms) AS froms, any_value(tags) AS tags,
           min({{'c': CAST(costs[s + 1] + cost AS INTEGER), 'n': steps[s + 1] + 1, 's': CAST(s AS INTEGER), 'tag': tag}}) AS m
    FROM best JOIN ways USING (run) WHERE e = i + 1 GROUP BY run, i)),
 back AS (
  SELECT run, length(run) AS e, froms, tags FROM best WHERE i = length(run)
  UNION ALL SELECT run, froms[e + 1], froms, tags FROM back WHERE e > 0),
 cuts AS (
  SELECT run, froms[e + 1] AS s, substr(run, froms[e + 1] + 1, e - froms[e + 1]) AS word, tags[e + 1] AS tag FROM back WHERE e > 0),
 known AS (SELECT * FROM cuts WHERE tag <> '{seg.UNKNOWN_TAG}'),
 per_run AS (
  SELECT run, count(*) AS n, list(word ORDER BY s) FILTER (substr(tag, 1, 3) IN ('NNG', 'NNP') AND length(word) >= 3) AS kept
  FROM known GROUP BY run),
 placed AS (
  SELECT doc_id, unnest(w) AS run, generate_subscripts(w, 1) AS k FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}{{2,}}') AS w FROM documents)),
 found AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_known, array_to_string(flatten(list(coalesce(kept, []) ORDER BY k)), ' ') AS tokens
  FROM placed JOIN per_run USING (run) GROUP BY doc_id)
 SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN found USING (doc_id)"""


def word_starts(spark, sf):
    """(word): the starts of all words of the benchmark."""
    found = fx.table(spark, sf, "benchmark").select(F.explode(text.words(F.lower("text"), fx.WORD)).alias("w")).distinct()
    starts = F.transform(F.sequence(F.lit(2), F.char_length("w")), lambda k: F.substring("w", F.lit(1), k))
    return found.select(F.explode(starts).alias("word")).distinct()


def _segmented(spark, sf, **limits):
    size = F.char_length("word")
    tag = F.when(size % 3 == 0, "NNG").when(size % 3 == 1, "VV-x").otherwise("NNP")
    dictionary = word_starts(spark, sf).select("word", tag.alias("tag"), (12 + size % 4).alias("cost"))
    return seg.segment(fx.news(spark, sf).select("doc_id", "content"), dictionary, F.lower("content"), fx.WORD, **limits)


def _segments_shown(docs):
    known = F.filter("pieces", lambda p: p["tag"] != seg.UNKNOWN_TAG)
    kept = seg.kept_words("pieces", ["NNG", "NNP"], (), 3)
    return docs.select("doc_id", F.size(known).alias("n_known"), F.array_join(kept, " ").alias("tokens"))


@query("segmented_tokens", SEGMENT_SQL)
def segmented_tokens(spark, sf):
    return _segments_shown(_segmented(spark, sf))


@query("segmented_tokens_joined", SEGMENT_SQL)
def segmented_tokens_joined(spark, sf):
    """The same with a dictionary that is too large to be sent to the tasks."""
    return _segments_shown(_segmented(spark, sf, max_bytes=0))


@query(
    "preview",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id, sentiment, sentiment_num FROM news ORDER BY doc_id LIMIT 10""",
)
def preview(spark, sf):
    return fx.scored_news(spark, sf).select("doc_id", "sentiment", "sentiment_num").orderBy("doc_id").limit(10)


@query(
    "doc_keywords",
    r"""WITH placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(text, '\p{L}{2,}') AS w FROM documents)),
 counted AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM placed GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM counted),
 top AS (SELECT doc_id, string_agg(word, ', ' ORDER BY r) AS keywords FROM ranked WHERE r <= 5 GROUP BY 1)
 SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN top USING (doc_id)""",
)
def doc_keywords(spark, sf):
    docs = kw.doc_keywords(fx.news(spark, sf).select("doc_id", "content"), "content", fx.WORD)
    return docs.select("doc_id", F.array_join("keywords", ", ").alias("keywords"))
