"""Text expressions: cleaning, summaries, tokens, n-grams, term counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions import fixed


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.trim(as_col(c), F.lit(fixed.SPACE_CHARS))


def full_text(title: Column | str, content: Column | str) -> Column:
    return F.concat_ws(" ", text_or_empty(title), text_or_empty(content))


def model_text(
    title: Column | str,
    content: Column | str,
    prefix: int | None = fixed.BODY_PREFIX,
    title_repeats: int = 2,
    limit: int | None = None,
    trim: bool = True,
) -> Column:
    """Text handed to the scorer: the title, repeated, and the body's start.

    ``limit=512, trim=False`` is the polling form; ``prefix=None,
    title_repeats=1, trim=False`` is the stored-table form.
    """
    body = text_or_empty(content)
    if prefix is not None:
        body = F.substring(body, 1, prefix)
    text = F.concat_ws(" ", *[text_or_empty(title)] * title_repeats, body)
    if trim:
        text = strip(text)
    if limit is not None:
        text = F.substring(text, 1, limit)
    return text


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), f"(?U){fixed.WS}+", " "))


def clean_text(c: Column | str) -> Column:
    """Drop URLs, e-mail addresses, tags, symbols and all-digit words.

    The e-mail pattern starts only at the start of a run of non-spaces and
    never backs up, and an unclosed ``<`` consumes the rest once, so both
    stay linear in the length of the text.
    """
    ws, not_ws = fixed.WS, fixed.NOT_WS
    text = F.regexp_replace(text_or_empty(c), rf"(?U)https?://{not_ws}+", "")
    text = F.regexp_replace(text, rf"(?U)(\A|{ws}){not_ws}[^@\s\x1c-\x1f]*+@{not_ws}+", "$1")
    text = F.regexp_replace(text, r"<[^>]+>|(<[^>]*\z)", "$1")
    text = F.regexp_replace(text, fixed.NOT_WORD, " ")
    text = F.regexp_replace(text, r"(?=\p{Nd})(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])", "")
    return collapse_spaces(text)


def lines(c: Column | str) -> Column:
    """Trimmed, non-blank lines as an array."""
    return F.filter(
        F.transform(F.split(as_col(c), fixed.LINE_BREAK), strip),
        lambda line: line != "",
    )


def strip_boilerplate(c: Column | str, patterns: Sequence[str] = fixed.BOILERPLATE) -> Column:
    """Remove every pattern in turn, then tidy the lines that are left."""
    text = text_or_empty(c)
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return F.array_join(lines(text), "\n")


_BREAK = rf"(?U)(?<=[{fixed.SENTENCE_END}]){fixed.WS}+"


def sentences(c: Column | str) -> Column:
    return F.split(collapse_spaces(c), _BREAK)


def lead_summary(c: Column | str, n: int = 3) -> Column:
    """The first ``n`` sentences; the split stops there, however long the text."""
    head = F.slice(F.split(text_or_empty(c), _BREAK, n + 1), 1, n)
    return collapse_spaces(F.array_join(head, " "))


def is_blank(c: Column | str) -> Column:
    return ~text_or_empty(c).rlike(rf"(?U){fixed.NOT_WS}")


def ends_sentence(c: Column | str) -> Column:
    """Whether the text has a break, when another text follows it."""
    return text_or_empty(c).rlike(rf"(?U)[{fixed.SENTENCE_END}](?:{fixed.WS}|\z)")


def sentence_breaks(c: Column | str, up_to: int) -> Column:
    """Breaks of a text that another text follows, counted up to a limit."""
    return F.size(F.split(F.concat(text_or_empty(c), F.lit(" ")), _BREAK, up_to + 1)) - 1


def words(c: Column | str, pattern: str = fixed.HANGUL_WORD) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0))


def tokens(
    c: Column | str,
    pattern: str = fixed.LETTER_WORD,
    stopwords: Sequence[str] = fixed.STOPWORDS,
    min_length: int = 2,
) -> Column:
    """Words of at least ``min_length`` characters that are not stopwords."""
    keep = lambda w: F.char_length(w) >= min_length
    if stopwords:
        keep = lambda w: (F.char_length(w) >= min_length) & ~w.isin(list(stopwords))
    return F.filter(words(c, pattern), keep)


def ngrams(tokens_col: Column | str, n: int = 2) -> Column:
    t = as_col(tokens_col)
    grams = F.transform(
        F.sequence(F.lit(1), F.size(t) - (n - 1)),
        lambda i: F.array_join(F.slice(t, i, n), " "),
    )
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def term_counts(tokens_col: Column | str) -> Column:
    """Per-row term counts: array of (word, n, first_pos), ordered by word.

    Sorting the tokens inside the row makes equal words adjacent, so a row's
    counts need no shuffle.
    """
    placed = F.sort_array(
        F.transform(as_col(tokens_col), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    )

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 1)["word"] != F.get(s, i - 2)["word"]),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda start, j: F.struct(
                    F.get(s, start - 1)["word"].alias("word"),
                    (F.coalesce(F.get(b, j + 1), F.size(s) + 1) - start).alias("n"),
                    F.get(s, start - 1)["pos"].alias("first_pos"),
                ),
            ),
        )

    return let(
        placed,
        lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(
            F.array().cast("array<struct<word:string,n:int,first_pos:int>>")
        ),
    )


def top_terms(counts: Column | str, n: int = 5) -> Column:
    """The ``n`` most frequent words of a row, ties by first appearance."""
    ranked = F.sort_array(
        F.transform(
            as_col(counts),
            lambda t: F.struct((-t["n"]).alias("k"), t["first_pos"].alias("p"), t["word"].alias("word")),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda t: t["word"])


def has_script(c: Column | str, script: str = fixed.HANGUL, longer_than: int = 10) -> Column:
    return F.coalesce(as_col(c).rlike(script), F.lit(False)) & (F.char_length(as_col(c)) > longer_than)


def longest(candidates: Column | str) -> Column:
    """The longest text of an array, the first one on ties; null when empty."""
    ranked = F.sort_array(
        F.transform(
            as_col(candidates),
            lambda t, i: F.struct((-F.char_length(t)).alias("k"), i.alias("i"), t.alias("text")),
        )
    )
    return F.get(ranked, F.lit(0))["text"]


def first_filled(*candidates: Column | str) -> Column:
    """First candidate that is not blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates])
