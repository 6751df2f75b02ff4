"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.functions.text import as_col, text_or_empty

_FORMATS = [None, "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "yyyy.MM.dd."]


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp of a text in any known layout, null when none fits."""
    text = F.trim(as_col(c))
    return F.coalesce(
        *[F.try_to_timestamp(text) if f is None else F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS]
    )


def parse_timestamp_strict(c: Column | str) -> Column:
    """Timestamp of a text; a bad text fails the job."""
    return F.to_timestamp(as_col(c))


def year_month(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def dotted(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy.MM.dd")


def iso_like(c: Column | str) -> Column:
    return F.replace(as_col(c).cast("string"), F.lit(" "), F.lit("T"))


def looks_like_date(c: Column | str, pattern: str = fixed.DATE_LIKE) -> Column:
    text = text_or_empty(c)
    return text.rlike(pattern) & (F.char_length(text) < fixed.MAX_DATE_TEXT)
