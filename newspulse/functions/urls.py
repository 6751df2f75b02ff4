"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions.text import as_col


def normalise(url: Column | str) -> Column:
    """Cut at the first ``?`` and drop trailing slashes; fragments stay."""
    return F.rtrim(F.substring_index(as_col(url), "?", 1), F.lit("/"))


def url_hash(url: Column | str) -> Column:
    return F.sha2(as_col(url), 256)


def site(url: Column | str) -> Column:
    """Scheme and host of an absolute URL."""
    return F.regexp_extract(as_col(url), r"^(https?://[^/?#]+)", 1)


def host(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"^https?://([^/?#]+)", 1)


def absolute(link: Column, page_url: Column | str) -> Column:
    """Resolve a link found on a page: absolute, protocol-relative or rooted."""
    base = site(page_url)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(
            F.concat(
                F.regexp_extract(F.substring_index(F.substring_index(as_col(page_url), "?", 1), "#", 1),
                                 r"^(https?://[^/]+(?:/.*(?=/))?)", 1),
                F.lit("/"),
                link,
            )
        )
    )


def accepted(url: Column | str, contains: str | None = None) -> Column:
    """Non-empty, starts with http and, when asked, contains a domain or path."""
    u = as_col(url)
    ok = u.isNotNull() & u.startswith("http")
    return ok & u.contains(contains) if contains else ok
