"""Label expressions: polarity, lexicon score, confidence gate, refinement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.functions.text import as_col, text_or_empty


def polarity(label: Column | str, unknown: int | None = 0, fold: bool = True, trim: bool = False) -> Column:
    """Label to -1, 0 or 1.

    ``fold`` ignores case, ``trim`` ignores outer blanks, ``unknown`` is the
    value of any other or missing label (``None`` keeps it null).
    """
    key = as_col(label)
    if fold:
        key = F.lower(key)
    if trim:
        key = F.trim(key)
    return (
        F.when(key == "positive", 1)
        .when(key == "negative", -1)
        .when(key == "neutral", 0)
        .otherwise(F.lit(unknown).cast("int"))
    )


def occurrences(c: Column | str, word: str) -> Column:
    """Non-overlapping occurrences of a literal; lengths are compared in bytes."""
    text = text_or_empty(c)
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
    return (removed / len(word.encode())).cast("int")


def keyword_score(c: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    score = F.lit(0)
    for word in positive:
        score = score + occurrences(c, word)
    for word in negative:
        score = score - occurrences(c, word)
    return score


def lexicon_score(
    title: Column | str,
    content: Column | str,
    positive: Sequence[str] = fixed.POSITIVE_WORDS,
    negative: Sequence[str] = fixed.NEGATIVE_WORDS,
) -> Column:
    """Title hits count twice, body hits once."""
    return keyword_score(title, positive, negative) * 2 + keyword_score(content, positive, negative)


def refine(
    label: Column | str,
    confidence: Column | str,
    score: Column | str,
    threshold: float = fixed.REFINE_THRESHOLD,
    lexicon_correction: bool = True,
) -> Column:
    """Final label; ``lexicon_correction=False`` passes the label through."""
    if not lexicon_correction:
        return as_col(label)
    return (
        F.when(as_col(confidence) < threshold, "neutral")
        .when(as_col(score) >= fixed.LEXICON_MARGIN, "positive")
        .when(as_col(score) <= -fixed.LEXICON_MARGIN, "negative")
        .otherwise(as_col(label))
    )


def gate_label(label: Column | str, score: Column | str, threshold: float | None = fixed.GATE_THRESHOLD) -> Column:
    """Lower-case label, neutral when the unrounded score is below threshold."""
    lowered = F.lower(as_col(label))
    if threshold is None:
        return lowered
    return F.when(as_col(score) < threshold, "neutral").otherwise(lowered)


def argmax_label(probabilities: Column | str, labels: Sequence[str] = fixed.LABELS) -> Column:
    p = as_col(probabilities)
    return F.get(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int") - 1)
