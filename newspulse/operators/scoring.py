"""Sentiment scoring: the lexicon scorer and the hook for a user's model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import fixed, sentiment, text

log = logging.getLogger(__name__)

Scorer = Callable[[list[str]], Sequence[tuple[str, float]]]


def score_with_lexicon(
    articles: DataFrame,
    positive: Sequence[str] = fixed.POSITIVE_WORDS,
    negative: Sequence[str] = fixed.NEGATIVE_WORDS,
    threshold: float | None = fixed.GATE_THRESHOLD,
    text_col: str = "model_text",
) -> DataFrame:
    """Score without a model: the sign of the keyword score gives the label.

    Confidence is our own choice, ``min(1, 0.5 + 0.1 * abs(score))``. Blank
    text is neutral with confidence 0.
    """
    score = sentiment.keyword_score(text_col, positive, negative)
    raw = F.least(F.lit(1.0), F.lit(0.5) + F.abs("_score") * 0.1)
    label = F.when(F.col("_score") > 0, "positive").when(F.col("_score") < 0, "negative").otherwise("neutral")
    blank = text.strip(text.text_or_empty(text_col)) == ""
    return (
        articles.withColumn("_score", score)
        .withColumn("sentiment", F.when(blank, "neutral").otherwise(sentiment.gate_label(label, raw, threshold)))
        .withColumn("confidence", F.when(blank, 0.0).otherwise(F.round(raw, 4)))
        .drop("_score")
    )


def score_with_model(
    articles: DataFrame,
    scorer_factory: Callable[[], Scorer],
    threshold: float | None = fixed.GATE_THRESHOLD,
    digits: int | None = 4,
    batch_size: int = fixed.SCORER_BATCH,
    text_col: str = "model_text",
) -> DataFrame:
    """Score with a model that ``scorer_factory`` loads once per task.

    Only the text column travels to Python. A scorer takes a list of texts and returns (label, score) for each. Blank
    text is neutral, 0.0 without a call; a batch whose call fails is neutral,
    0.0 as a whole, and the first failure of a task is logged with the number
    of failed batches at its end. ``threshold=None, digits=None`` gives the
    plain argmax form.
    """
    @F.pandas_udf("sentiment string, confidence double")
    def scores_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, failed = scorer_factory(), 0
        for series in batches:
            texts = series.fillna("").tolist()
            filled = [i for i, t in enumerate(texts) if t.strip()]
            labels, scores = ["neutral"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(filled), batch_size):
                rows = filled[at : at + batch_size]
                try:
                    results = [(lab.lower(), float(s)) for lab, s in scorer([texts[i] for i in rows])]
                    if len(results) != len(rows):
                        raise ValueError("a scorer must return one result per text")
                except Exception:
                    failed += 1
                    if failed == 1:
                        log.exception("a scorer failed; its texts count as neutral")
                    continue
                for i, (lab, s) in zip(rows, results):
                    labels[i] = "neutral" if threshold is not None and s < threshold else lab
                    scores[i] = s if digits is None else round(s, digits)
            yield pd.DataFrame({"sentiment": labels, "confidence": scores})
        if failed:
            log.error("%d batches of this task failed in the scorer", failed)

    # Marked nondeterministic so that no later filter runs the model again.
    scored = articles.drop("sentiment", "confidence").withColumn(
        "_scored", scores_of.asNondeterministic()(F.col(text_col))
    )
    return scored.select("*", "_scored.sentiment", "_scored.confidence").drop("_scored")


def refine_articles(
    scored: DataFrame,
    positive: Sequence[str] = fixed.POSITIVE_WORDS,
    negative: Sequence[str] = fixed.NEGATIVE_WORDS,
    lexicon_correction: bool = True,
) -> DataFrame:
    """Add the final label, its polarity and the lead summary."""
    score = sentiment.lexicon_score("title", "content", positive, negative)
    return (
        scored.withColumn("_score", score)
        .withColumn(
            "final_sentiment",
            sentiment.refine("sentiment", "confidence", "_score", lexicon_correction=lexicon_correction),
        )
        .drop("_score")
        .withColumn("sentiment_num", sentiment.polarity("final_sentiment", trim=True))
        .withColumn("summary", text.lead_summary("content"))
    )
