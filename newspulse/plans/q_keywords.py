"""Queries over term statistics."""

from __future__ import annotations

from newspulse.functions import text
from newspulse.operators import keywords as kw
from newspulse.plans import fixtures as fx
from newspulse.plans.registry import query

BIGRAMS_SQL = """bigrams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS word
  FROM token_docs WHERE len(tokens) >= 2)"""
CURVE_SQL = """zipf AS (
  SELECT row_number() OVER (ORDER BY n DESC) AS rank, n AS freq FROM (SELECT word, count(*) AS n FROM words GROUP BY 1))"""
HEAPS_SQL = """fresh AS (SELECT doc_id, count(*) AS new FROM (
    SELECT word, min(doc_id) AS doc_id FROM words GROUP BY 1) GROUP BY 1),
 heaps AS (
  SELECT doc_id, CAST(sum(len(tokens)) OVER o AS BIGINT) AS total_tokens,
         CAST(sum(coalesce(new, 0)) OVER o AS BIGINT) AS vocabulary
  FROM token_docs LEFT JOIN fresh USING (doc_id) WINDOW o AS (ORDER BY doc_id))"""


@query("word_freq", f"WITH {fx.TOKENS_SQL} SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
def word_freq(spark, sf):
    return kw.top_words(kw.word_counts(fx.token_docs(spark, sf)), 30)


@query(
    "bigram_freq",
    f"WITH {fx.TOKENS_SQL}, {BIGRAMS_SQL} SELECT word, count(*) AS n FROM bigrams GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
)
def bigram_freq(spark, sf):
    return kw.top_words(kw.word_counts(fx.token_docs(spark, sf), text.ngrams("tokens")), 20)


@query(
    "corpus_stats",
    f"""WITH {fx.TOKENS_SQL}, {BIGRAMS_SQL}
 SELECT (SELECT count(*) FROM token_docs) AS documents, (SELECT count(*) FROM words) AS tokens,
        (SELECT count(DISTINCT word) FROM words) AS distinct_words,
        (SELECT count(DISTINCT word) FROM bigrams) AS distinct_bigrams""",
)
def corpus_stats(spark, sf):
    return kw.corpus_stats(fx.token_docs(spark, sf))


@query(
    "tfidf_top",
    f"""WITH {fx.TOKENS_SQL}, total AS (SELECT count(*) AS total FROM token_docs),
 tf AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY 1, 2),
 vocabulary AS (
  SELECT word, ln((1 + total) / (1 + df)) + 1 AS idf FROM (
    SELECT word, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1), total
  WHERE df >= 5 AND df <= 0.8 * total ORDER BY cf DESC, word LIMIT 200),
 x AS (SELECT doc_id, word, tf * idf AS x FROM tf JOIN vocabulary USING (word)),
 unit AS (SELECT word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM x)
 SELECT word, round(sum(u) / (SELECT total FROM total), 6) AS score FROM unit GROUP BY 1
 ORDER BY sum(u) DESC, word LIMIT 30""",
)
def tfidf_top(spark, sf):
    return kw.tfidf_top(fx.token_docs(spark, sf))


CLASS_SQL = """class_top AS (SELECT * FROM (
  SELECT sentiment AS label, word, count(*) AS n, row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, word) AS rank
  FROM words GROUP BY 1, 2))"""


@query("class_top_words", f"WITH {fx.TOKENS_SQL}, {CLASS_SQL} SELECT label, word, n, rank FROM class_top WHERE rank <= 20")
def class_top_words(spark, sf):
    return kw.class_top_words(fx.token_docs(spark, sf), "sentiment")


@query(
    "class_word_weights",
    f"""WITH {fx.TOKENS_SQL}, {CLASS_SQL}
 SELECT label, word, n, round(n / max(n) OVER (PARTITION BY label), 6) AS weight FROM class_top WHERE rank <= 100""",
)
def class_word_weights(spark, sf):
    return kw.class_word_weights(fx.token_docs(spark, sf), "sentiment")


@query("zipf_curve", f"WITH {fx.TOKENS_SQL}, {CURVE_SQL} SELECT rank, freq FROM zipf")
def zipf_curve(spark, sf):
    return kw.zipf_curve(kw.word_counts(fx.token_docs(spark, sf)))


@query(
    "zipf_fit",
    f"""WITH {fx.TOKENS_SQL}, {CURVE_SQL}, fit AS (
  SELECT count(*) AS words, regr_slope(log10(freq), log10(rank)) AS slope,
         regr_intercept(log10(freq), log10(rank)) AS intercept FROM zipf)
 SELECT words, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
        CASE WHEN abs(slope + 1) < 0.3 THEN 'holds' ELSE 'partial' END AS verdict FROM fit""",
)
def zipf_fit(spark, sf):
    return kw.zipf_fit(kw.zipf_curve(kw.word_counts(fx.token_docs(spark, sf))))


@query("heaps_curve", f"WITH {fx.TOKENS_SQL}, {HEAPS_SQL} SELECT doc_id, total_tokens, vocabulary FROM heaps")
def heaps_curve(spark, sf):
    return kw.heaps_curve(fx.token_docs(spark, sf), "doc_id")


@query(
    "heaps_fit",
    f"""WITH {fx.TOKENS_SQL}, {HEAPS_SQL}, fit AS (
  SELECT count(*) AS points, max(total_tokens) AS tokens,
         regr_slope(log10(greatest(vocabulary, 1)), log10(greatest(total_tokens, 1))) AS beta FROM heaps)
 SELECT points, tokens, round(beta, 6) AS beta,
        CASE WHEN beta BETWEEN 0.3 AND 0.7 THEN 'holds' ELSE 'partial' END AS verdict FROM fit""",
)
def heaps_fit(spark, sf):
    return kw.heaps_fit(kw.heaps_curve(fx.token_docs(spark, sf), "doc_id"))
