"""Page expressions over a raw HTML column."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.functions.text import as_col, first_filled, let, lines, strip, text_or_empty

# Named character references of HTML 4, from the standard library.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
# --- Fixed values: where a page keeps its parts, in order of preference ---
BODY_CONTAINERS = [("article", ""), ("div", r'\sid="content"'), ("main", "")]
TITLE_TAGS = ["h1", "title"]
DATE_TAGS = ["time"]

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TAG = r"<[^>]+>"


def visible_html(html: Column | str) -> Column:
    """The page without comments, scripts and styles."""
    return without_hidden(html, "")


def without_hidden(html: Column | str, instead: str) -> Column:
    """The page with ``instead`` in place of comments, scripts and styles."""
    return F.regexp_replace(text_or_empty(html), _HIDDEN, instead)


def unescape(c: Column | str) -> Column:
    """Replace named and numeric character references, each one once."""
    text = as_col(c)
    names = F.split(F.lit("\x00".join(ENTITIES)), "\x00")
    table = F.map_from_arrays(names, F.split(F.lit("\x00".join(ENTITIES.values())), "\x00"))

    def decoded(part: Column) -> Column:
        return let(
            F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1),
            lambda name: F.when(name == "", F.concat(F.lit("&"), part)).otherwise(
                F.coalesce(
                    F.concat(
                        F.when(name.startswith("#"), _numbered(name)).otherwise(F.try_element_at(table, name)),
                        F.substr(part, F.char_length(name) + 2),
                    ),
                    F.concat(F.lit("&"), part),
                )
            ),
        )

    pieces = let(
        F.split(text, "&"),
        lambda p: F.array_join(F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), ""),
    )
    return F.when(text.contains("&"), pieces).otherwise(text)


def _numbered(name: Column) -> Column:
    """Character of ``#39`` or ``#x27``; null outside the Unicode range."""
    digits = F.substr(name, F.lit(2))
    code = F.when(
        F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)
    ).otherwise(digits).cast("long")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def inner_html(html: Column | str, tag: str, attributes: str = "") -> Column:
    """Inner HTML of the first matching element, empty when there is none.

    The text after the opening tag is cut before every further tag of the
    same name; the depth of those cuts finds the matching closing tag.
    """
    # The group keeps the > of the opening tag: a cut at the very start of a
    # text would make no empty first part.
    opening = rf"(?is)<{tag}\b[^>]*{attributes}[^>]*(>.*)\z" if attributes else rf"(?is)<{tag}\b[^>]*(>.*)\z"
    cut = F.split(F.regexp_extract(text_or_empty(html), opening, 1), rf"(?i)(?=</?{tag}\b)")

    def matching(parts: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("keep"))
        step = lambda acc, part: F.when(
            acc["depth"] == 0, acc
        ).otherwise(
            let(
                acc["depth"] + F.when(part.startswith("</"), -1).otherwise(1),
                lambda depth: F.struct(
                    depth.alias("depth"),
                    (acc["keep"] + F.when(depth == 0, 0).otherwise(1)).alias("keep"),
                ),
            )
        )
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        keep = F.aggregate(rest, start, step)["keep"]
        return F.substr(F.array_join(F.slice(parts, 1, keep), ""), F.lit(2))

    return let(cut, matching)


def joined_text(html: Column | str) -> Column:
    """Text pieces between tags, each trimmed, put together without a gap."""
    pieces = F.transform(F.split(as_col(html), _TAG), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "")


def first_element_texts(html: Column | str, tags: Sequence[str]) -> Column:
    """Text of the first element of each tag, as an array."""
    found = [F.regexp_extract(text_or_empty(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1) for tag in tags]
    return F.transform(F.array(*found), joined_text)


def element_texts(html: Column | str, tag: str) -> Column:
    """Text of every element with this tag, in page order."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(found, joined_text)


def text_lines(html: Column | str) -> Column:
    """Text of an HTML fragment, one line per text piece."""
    return F.array_join(lines(unescape(F.regexp_replace(as_col(html), _TAG, "\n"))), "\n")


def strip_site_suffix(title: Column | str, site_names: Sequence[str]) -> Column:
    """Drop a trailing ``- site name`` or ``| site name``."""
    if not site_names:
        return strip(title)
    names = "|".join(site_names)
    return strip(F.regexp_replace(as_col(title), rf"(?d)\s*[-|]\s*({names}).*$", ""))


def page_title(
    html: Column | str,
    fallback: Column | str | None = None,
    tags: Sequence[str] = TITLE_TAGS,
    site_names: Sequence[str] = (),
) -> Column:
    """First filled title element, else the list title, without site suffix."""
    in_page = F.get(F.filter(first_element_texts(html, tags), lambda t: t != ""), F.lit(0))
    candidates = [in_page] if fallback is None else [in_page, as_col(fallback)]
    return strip_site_suffix(F.coalesce(first_filled(*candidates), F.lit("")), site_names)


def page_body(
    html: Column | str,
    containers: Sequence[tuple[str, str]] = BODY_CONTAINERS,
    min_length: int = fixed.MIN_BODY_ELEMENT,
) -> Column:
    """Lines of the first container with enough text; null when none has."""
    inner = F.array(*[inner_html(html, tag, attributes) for tag, attributes in containers])
    filled = F.filter(inner, lambda h: F.char_length(joined_text(h)) > min_length)
    return F.get(F.transform(F.slice(filled, 1, 1), text_lines), F.lit(0))


def page_date(html: Column | str, fallback: Column | str | None = None, tags: Sequence[str] = DATE_TAGS) -> Column:
    """Data attribute, then published-time meta, then visible text, then list."""
    page = text_or_empty(html)
    quoted = r"=\s*[\"']([^\"']*)[\"']"
    published = r"property\s*=\s*[\"']article:published_time[\"']"
    candidates = [
        F.regexp_extract(page, rf"(?is)\bdata-date-time\s*{quoted}", 1),
        F.regexp_extract(page, rf"(?is)<meta\b[^>]*{published}[^>]*\bcontent\s*{quoted}", 1),
        F.regexp_extract(page, rf"(?is)<meta\b[^>]*\bcontent\s*{quoted}[^>]*{published}", 1),
        F.get(F.filter(first_element_texts(page, tags), lambda t: t != ""), F.lit(0)),
    ]
    if fallback is not None:
        candidates.append(as_col(fallback))
    return first_filled(*candidates)


def page_publisher(html: Column | str, fallback: Column | str, logo: tuple[str, str] = ("div", "logo")) -> Column:
    """Alternative text of the logo image, else the list value."""
    alt = F.regexp_extract(inner_html(html, *logo), r"(?is)<img\b[^>]*\balt\s*=\s*[\"']([^\"']*)[\"']", 1)
    return first_filled(unescape(alt), fallback)


def page_links(html: Column | str) -> Column:
    """Targets of all anchors, in page order."""
    return F.transform(
        F.regexp_extract_all(
            text_or_empty(html), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)
        ),
        lambda u: strip(unescape(u)),
    )


def opening_tags(html: Column | str, tags: Sequence[str]) -> Column:
    """Opening tags of the given names as array of (tag, class)."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(rf"(?is)<(?:{'|'.join(tags)})\b[^>]*>"), F.lit(0))
    return F.transform(
        found,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^<([A-Za-z0-9]+)", 1)).alias("tag"),
            F.regexp_extract(t, r"(?is)\bclass\s*=\s*[\"']([^\"']*)[\"']", 1).alias("class"),
        ),
    )
