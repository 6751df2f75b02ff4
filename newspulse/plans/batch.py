"""The batch job: load, score, refine, save, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from newspulse.functions import fixed, text
from newspulse.operators.evaluate import label_distribution
from newspulse.operators.scoring import refine_articles, score_with_lexicon


def score_corpus(
    articles: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    positive: Sequence[str] = fixed.POSITIVE_WORDS,
    negative: Sequence[str] = fixed.NEGATIVE_WORDS,
    lexicon_correction: bool = True,
) -> DataFrame:
    """Articles with label, confidence, final label, polarity and summary.

    One lazy plan without a shuffle.
    """
    with_text = articles.withColumn("model_text", text.model_text("title", "content"))
    scored = scorer(with_text) if scorer else score_with_lexicon(with_text, positive, negative)
    return refine_articles(scored.drop("model_text"), positive, negative, lexicon_correction)


def run(articles: DataFrame, path: str, **options) -> DataFrame:
    """Save the scored corpus and return the distribution of final labels.

    The report reads the saved table: two columns of it, not the texts.
    """
    score_corpus(articles, **options).write.mode("overwrite").parquet(path)
    saved = articles.sparkSession.read.parquet(path)
    return label_distribution(saved, "final_sentiment", "confidence")
