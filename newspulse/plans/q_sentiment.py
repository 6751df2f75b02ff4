"""Queries over scoring, refinement and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.functions import sentiment, text
from newspulse.operators import evaluate, lexicon, scoring
from newspulse.plans import fixtures as fx
from newspulse.plans.q_text import DICTIONARY_SQL, STRIP, word_starts
from newspulse.plans.registry import query


def _hits_sql(c: str, word: str) -> str:
    return f"(length({c}) - length(replace({c}, '{word}', ''))) // {len(word)}"


def keyword_sql(c: str) -> str:
    plus = " + ".join(_hits_sql(c, w) for w in fx.POSITIVE)
    minus = " - ".join(_hits_sql(c, w) for w in fx.NEGATIVE)
    return f"({plus} - {minus})"


SCORE_SQL = f"(2 * {keyword_sql('title')} + {keyword_sql('content')})"
REFINE_SQL = f"""CASE WHEN confidence < 0.7 THEN 'neutral' WHEN {SCORE_SQL} >= 2 THEN 'positive'
  WHEN {SCORE_SQL} <= -2 THEN 'negative' ELSE sentiment END"""


def _score():
    return sentiment.lexicon_score("title", "content", fx.POSITIVE, fx.NEGATIVE)


@query("lexicon_score", f"WITH {fx.NEWS_SQL} SELECT doc_id, {SCORE_SQL} AS score FROM news")
def lexicon_score(spark, sf):
    return fx.news(spark, sf).select("doc_id", _score().alias("score"))


# A lexicon of some thousand word starts, positive and negative by their length.
LEXICON_SQL = f"""{DICTIONARY_SQL}, lexicon AS (SELECT word, 2 - length(word) % 4 AS weight FROM pieces)"""


def _lexicon(spark, sf):
    return word_starts(spark, sf).select("word", (2 - F.char_length("word") % 4).alias("weight"))


TABLE_SCORE_SQL = f"""WITH {fx.NEWS_SQL}, {LEXICON_SQL}
 SELECT doc_id, CAST(sum(weight * (2 * ({_hits_sql('title', 'W')}) + ({_hits_sql('content', 'W')}))) AS BIGINT) AS score
 FROM news, lexicon GROUP BY doc_id""".replace("'W'", "word").replace("// 1", "// length(word)")


@query("lexicon_table_score", TABLE_SCORE_SQL)
def lexicon_table_score(spark, sf):
    return lexicon.table_score(fx.news(spark, sf), _lexicon(spark, sf), {"title": 2, "content": 1}).select("doc_id", "score")


@query("lexicon_table_score_parts", TABLE_SCORE_SQL)
def lexicon_table_score_parts(spark, sf):
    """The same with a lexicon that is dealt into parts."""
    docs, words = fx.news(spark, sf), _lexicon(spark, sf)
    return lexicon.table_score(docs, words, {"title": 2, "content": 1}, max_bytes=10_000).select("doc_id", "score")


@query(
    "lexicon_word_hits",
    f"""WITH {fx.NEWS_SQL}, {LEXICON_SQL} SELECT word, count(*) AS documents, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT word, {_hits_sql('content', 'W')} AS n FROM news, lexicon) WHERE n > 0 GROUP BY 1""".replace("'W'", "word").replace("// 1", "// length(word)"),
)
def lexicon_word_hits(spark, sf):
    hits = lexicon.word_hits(fx.news(spark, sf), _lexicon(spark, sf), "doc_id", "content")
    return hits.groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))


@query("refine_sentiment", f"WITH {fx.NEWS_SQL} SELECT doc_id, {REFINE_SQL} AS final_sentiment, sentiment AS passed FROM news")
def refine_sentiment(spark, sf):
    scored = fx.news(spark, sf).withColumn("score", _score())
    return scored.select(
        "doc_id",
        sentiment.refine("sentiment", "confidence", "score").alias("final_sentiment"),
        sentiment.refine("sentiment", "confidence", "score", lexicon_correction=False).alias("passed"),
    )


@query(
    "confidence_gate",
    f"""WITH {fx.NEWS_SQL} SELECT doc_id, CASE WHEN confidence < 0.6 THEN 'neutral' ELSE lower(upper(sentiment)) END AS label,
  round(confidence, 4) AS confidence, lower(sentiment) AS ungated FROM news""",
)
def confidence_gate(spark, sf):
    return fx.news(spark, sf).select(
        "doc_id",
        sentiment.gate_label(F.upper("sentiment"), "confidence").alias("label"),
        F.round("confidence", 4).alias("confidence"),
        sentiment.gate_label("sentiment", "confidence", threshold=None).alias("ungated"),
    )


@query(
    "polarity",
    f"""WITH {fx.NEWS_SQL}, messy AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sentiment WHEN 1 THEN upper(sentiment) || ' ' WHEN 2 THEN upper(sentiment)
         ELSE 'other' END AS label FROM news)
 SELECT doc_id, label,
  CASE lower(trim(label)) WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END::BIGINT AS trimmed,
  CASE lower(label) WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END::BIGINT AS folded,
  CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END::BIGINT AS exact,
  CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END::BIGINT AS mapped
 FROM messy""",
)
def polarity(spark, sf):
    case = F.col("doc_id") % 4
    label = (
        F.when(case == 0, F.col("sentiment"))
        .when(case == 1, F.concat(F.upper("sentiment"), F.lit(" ")))
        .when(case == 2, F.upper("sentiment"))
        .otherwise("other")
    )
    messy = fx.news(spark, sf).select("doc_id", label.alias("label"))
    return messy.select(
        "doc_id", "label",
        sentiment.polarity("label", trim=True).alias("trimmed"),
        sentiment.polarity("label").alias("folded"),
        sentiment.polarity("label", fold=False).alias("exact"),
        sentiment.polarity("label", fold=False, unknown=None).alias("mapped"),
    )


SCORED_SQL = f"""{fx.NEWS_SQL}, texts AS (
  SELECT *, {STRIP("title || ' ' || title || ' ' || substr(content, 1, 200)")} AS t FROM news),
 raw AS (SELECT *, {keyword_sql('t')} AS s FROM texts),
 scored AS (
  SELECT * EXCLUDE (sentiment, confidence, sentiment_num),
    CASE WHEN t = '' OR least(1.0, 0.5 + abs(s) * 0.1) < 0.6 THEN 'neutral' WHEN s > 0 THEN 'positive'
         WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN t = '' THEN 0.0 ELSE round(least(1.0, 0.5 + abs(s) * 0.1), 4) END::DOUBLE AS confidence
  FROM raw)"""


def _with_text(spark, sf):
    return fx.news(spark, sf).drop("sentiment", "confidence").withColumn(
        "model_text", text.model_text("title", "content")
    )


@query("score_articles", f"WITH {SCORED_SQL} SELECT doc_id, sentiment, round(confidence, 6) AS confidence FROM scored")
def score_articles(spark, sf):
    scored = scoring.score_with_lexicon(_with_text(spark, sf), fx.POSITIVE, fx.NEGATIVE)
    return scored.select("doc_id", "sentiment", "confidence")


def _counting(positive, negative):
    """A scorer in plain Python with the lexicon's rule, as a user would plug in."""

    def score(texts):
        out = []
        for t in texts:
            s = sum(t.count(w) for w in positive) - sum(t.count(w) for w in negative)
            label = "POSITIVE" if s > 0 else "NEGATIVE" if s < 0 else "NEUTRAL"
            out.append((label, min(1.0, 0.5 + abs(s) * 0.1)))
        return out

    return score


@query("score_with_model", f"WITH {SCORED_SQL} SELECT doc_id, sentiment, round(confidence, 6) AS confidence FROM scored")
def score_with_model(spark, sf):
    texts = _with_text(spark, sf).select("doc_id", "model_text")
    scorer = _counting(fx.POSITIVE, fx.NEGATIVE)
    return scoring.score_with_model(texts, lambda: scorer).select("doc_id", "sentiment", "confidence")


@query(
    "argmax_label",
    """WITH probs AS (SELECT vec_id, embedding[1:3] AS p FROM embeddings)
 SELECT vec_id, ['negative', 'neutral', 'positive'][list_position(p, list_max(p))] AS label,
        round(CAST(list_max(p) AS DOUBLE), 6) AS score FROM probs""",
)
def argmax_label(spark, sf):
    probs = fx.probabilities(spark, sf)
    return probs.select("vec_id", sentiment.argmax_label("p").alias("label"), F.array_max("p").alias("score"))


PAIRS_SQL = f"""{fx.NEWS_SQL}, {fx.HAND_SQL}, pairs AS (
  SELECT doc_id, hand_label AS t, {REFINE_SQL} AS p FROM news JOIN hand USING (doc_id))"""


def _pairs(spark, sf):
    scored = fx.news(spark, sf).withColumn("score", _score())
    final = scored.select("doc_id", sentiment.refine("sentiment", "confidence", "score").alias("final_sentiment"))
    return final.join(fx.hand_labels(spark, sf), "doc_id")


@query(
    "classification_report",
    f"""WITH {PAIRS_SQL}, classes AS (SELECT DISTINCT t AS label FROM pairs UNION SELECT DISTINCT p FROM pairs),
 counts AS (
  SELECT label, (SELECT count(*) FROM pairs WHERE t = label) AS support,
         (SELECT count(*) FROM pairs WHERE p = label) AS claimed,
         (SELECT count(*) FROM pairs WHERE t = label AND p = label) AS hits FROM classes),
 pr AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS precision,
               CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM counts),
 f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
 report AS (
  SELECT label, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f)
 SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
        CAST(support AS BIGINT) AS support FROM report""",
)
def classification_report(spark, sf):
    return evaluate.classification_report(_pairs(spark, sf), "hand_label", "final_sentiment")


@query(
    "confusion_matrix",
    f"""WITH {PAIRS_SQL}, shown AS (SELECT t, CASE WHEN doc_id % 7 = 0 THEN 'mixed' ELSE p END AS p FROM pairs),
 classes AS (SELECT t AS true_label FROM shown UNION SELECT p FROM shown)
 SELECT true_label, count(*) FILTER (p = 'mixed') AS pred_mixed, count(*) FILTER (p = 'negative') AS pred_negative,
        count(*) FILTER (p = 'neutral') AS pred_neutral, count(*) FILTER (p = 'positive') AS pred_positive
 FROM classes LEFT JOIN shown ON t = true_label GROUP BY 1""",
)
def confusion_matrix(spark, sf):
    """Some predictions carry a label that no hand label has."""
    label = F.when(F.col("doc_id") % 7 == 0, "mixed").otherwise(F.col("final_sentiment"))
    return evaluate.confusion_matrix(_pairs(spark, sf).withColumn("shown", label), "hand_label", "shown")
