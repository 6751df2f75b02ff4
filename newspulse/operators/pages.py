"""Article extraction over a table of raw pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newspulse.functions import fixed, html, text, urls
from newspulse.operators.rows import computed, exploded

# --- Fixed values: elements that never have a closing tag ------------------
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()


def extract_articles(
    pages: DataFrame,
    patterns: Sequence[str] = fixed.BOILERPLATE,
    site_names: Sequence[str] = (),
    list_title: Column | None = None,
    list_date: Column | None = None,
    list_press: Column | None = None,
    min_body: int = fixed.MIN_BODY,
) -> DataFrame:
    """Title, content, date and press of each page, with a reject reason.

    ``list_title``, ``list_date`` and ``list_press`` are the values of the
    list page, used where the page itself has none; a content of fewer than
    ``min_body`` characters is rejected.
    """
    null = F.lit(None).cast("string")
    visible = pages.withColumn("_page", html.visible_html("html"))
    kept = [c for c in pages.columns if c != "html"]
    parts = computed(
        visible,
        *kept,
        title=html.page_title("_page", list_title, site_names=site_names),
        _body=html.page_body("_page"),
        date=html.page_date("_page", null if list_date is None else list_date),
        press=html.page_publisher("_page", urls.host("url") if list_press is None else list_press),
    )
    content = computed(
        parts, *kept, "title", "date", "press", "_body", content=text.strip_boilerplate("_body", patterns)
    )
    return content.withColumn("reason", reject_reason("_body", "content", min_body)).drop("_body")


def reject_reason(body: Column | str, content: Column | str, min_body: int = fixed.MIN_BODY) -> Column:
    """Why an article is dropped; null for an accepted one."""
    size = F.char_length(text.text_or_empty(content))
    return F.when(text.as_col(body).isNull(), fixed.REASON_NO_BODY).when(
        size < min_body, F.concat(F.lit(f"{fixed.REASON_SHORT_BODY}("), size.cast("string"), F.lit("자)"))
    )


def title_or_placeholder(title: Column | str) -> Column:
    filled = text.text_or_empty(title)
    return F.when(filled == "", fixed.MISSING_TITLE).otherwise(filled)


def accepted_articles(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("reason").isNull()).drop("reason")


def rejected(extracted: DataFrame) -> DataFrame:
    """Rows for the rejection log."""
    return extracted.where(F.col("reason").isNotNull()).select("url", "reason")


@dataclass
class Routed:
    """Both outputs of one extraction, and how many rows went where."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def route(extracted: DataFrame, path: str) -> Routed:
    """Write accepted and rejected articles to two folders of ``path`` in one pass.

    The rows of each reason are counted while they are written, so neither
    output nor its size needs the pages again.
    """
    no_body, short = fixed.REASON_NO_BODY, fixed.REASON_SHORT_BODY
    reason = F.col("reason")
    seen = Observation()
    counted = extracted.observe(
        seen, F.count_if(reason.isNull()).alias("accepted"), F.count_if(reason == no_body).alias(no_body),
        F.count_if(reason.startswith(short)).alias(short))
    verdict = F.when(reason.isNull(), "accepted").otherwise("rejected")
    counted.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(path)
    spark = extracted.sparkSession
    stored = spark.read.schema(extracted.withColumn("verdict", F.lit("")).schema).parquet(path)
    of = lambda v: stored.where(F.col("verdict") == v).drop("verdict")
    return Routed(accepted_articles(of("accepted")), rejected(of("rejected")), dict(seen.get))


def count_reasons(log: DataFrame) -> DataFrame:
    """Rejections per kind of reason, lengths in brackets left out."""
    kind = F.regexp_replace("reason", r"\(\d+자\)$", "")
    return log.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def relevant(
    articles: DataFrame, keywords: Sequence[str], body_prefix: int | None = None, whole_body: bool = False
) -> DataFrame:
    """Articles whose title, or body start or whole body when asked, holds any keyword."""
    if not keywords:
        raise ValueError("keywords must not be empty")
    hit = F.lit(False)
    for word in keywords:
        hit = hit | text.text_or_empty("title").contains(word)
        if whole_body:
            hit = hit | text.text_or_empty("content").contains(word)
        elif body_prefix is not None:
            hit = hit | F.substring(text.text_or_empty("content"), 1, body_prefix).contains(word)
    return articles.where(hit)


def page_links(pages: DataFrame, contains: str | None = None, url: str = "url") -> DataFrame:
    """Accepted links per page, normalised, the first of equal ones kept."""
    resolved = F.transform(html.page_links(html.visible_html("html")), lambda u: urls.absolute(u, F.col(url)))
    kept = F.transform(F.filter(resolved, lambda u: urls.accepted(u, contains)), urls.normalise)
    found = pages.select("page_id", F.posexplode_outer(F.array_distinct(kept)).alias("pos", "link"))
    return found.where(F.col("link").isNotNull())


def tag_inventory(pages: DataFrame, tags: Sequence[str] = ("div", "article", "li", "a")) -> DataFrame:
    """Occurrences of every (tag, class) and the pages that hold it."""
    per_page = exploded(
        pages, array=text.let(html.opening_tags(html.visible_html("html"), tags), _count_structs), name="t"
    )
    return per_page.groupBy("t.tag", "t.class").agg(
        F.sum("t.n").alias("occurrences"), F.count(F.lit(1)).alias("pages")
    )


def _count_structs(found: Column) -> Column:
    keyed = F.transform(found, lambda t: F.concat_ws("\x00", t["tag"], t["class"]))
    return F.transform(
        text.term_counts(keyed),
        lambda t: F.struct(
            F.substring_index(t["word"], "\x00", 1).alias("tag"),
            F.substring_index(t["word"], "\x00", -1).alias("class"),
            t["n"].alias("n"),
        ),
    )


def matching_links(pages: DataFrame, contains: Sequence[str]) -> DataFrame:
    """Raw link targets that hold any of the given texts."""
    links = exploded(pages, "page_id", array=html.page_links(html.visible_html("html")), name="href")
    hit = F.lit(False)
    for piece in contains:
        hit = hit | F.col("href").contains(piece)
    return links.where(hit)


#: A tag, with any text inside quotes, or else a text piece.
_TOKEN = r"""<[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|<[^>]*+>|[^<]++"""


def link_containers(
    pages: DataFrame, tags: Sequence[str] = ("div", "article", "li"), need_class: bool = True, prefix: int = 30
) -> DataFrame:
    """Elements that hold text and at least one link: tag, class, text start.

    A page becomes an array of tags and text pieces; a stack that is kept over
    its opening and closing tags gives every element's extent. A closing tag
    also closes what was opened inside its element and not closed; one without
    an opening tag counts for nothing; what is never closed goes to the end.
    """
    wanted = [t for t in tags if t not in VOID_TAGS]
    cut = F.regexp_extract_all(html.without_hidden("html", "<!>"), F.lit(_TOKEN), F.lit(0))
    placed = computed(pages, "page_id", found=text.let(
        F.transform(cut, _token), lambda tokens: text.let(
            _extents(tokens, wanted), lambda spans: F.transform(spans, lambda s: _element(tokens, s, prefix)))))
    kept = F.filter("found", lambda e: e["link"] & (e["text"] != "") & (F.lit(not need_class) | e["class"].isNotNull()))
    found = placed.select("page_id", F.posexplode_outer(kept).alias("pos", "e")).where(F.col("e").isNotNull())
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "e.tag", F.coalesce("e.class", F.lit("")).alias("class"), "e.text")


def _token(t: Column) -> Column:
    tag = t.startswith("<")
    return F.struct(
        F.when(tag, F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))).otherwise("").alias("name"),
        t.startswith("</").alias("closing"),
        F.when(tag & ~t.endswith("/>"), t).alias("tag"),
        F.when(tag, "").otherwise(text.strip(html.unescape(t))).alias("text"),
    )


def _extents(tokens: Column, wanted: Sequence[str]) -> Column:
    """(i, j) of the elements with a wanted tag, by i: tokens between i and j, counted from 0, are inside."""
    marks = F.filter(
        F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["name"].alias("name"), t["closing"].alias("closing"), t["tag"].isNotNull().alias("opens"))),
        lambda m: m["name"].isin(list(wanted)) & (m["closing"] | m["opens"]))
    start = F.struct(
        F.array().cast("array<struct<i:int,name:string>>").alias("open"), F.array().cast("array<struct<i:int,j:int>>").alias("spans"))

    def ended(open_: Column, j: Column) -> Column:
        return F.transform(open_, lambda e: F.struct(e["i"].alias("i"), j.cast("int").alias("j")))

    def step(acc: Column, m: Column) -> Column:
        # The place of the last open element of this name; 0 if there is none.
        at = F.array_max(F.transform(acc["open"], lambda e, k: F.when(e["name"] == m["name"], k + 1).otherwise(0)))
        opened = F.struct(
            F.concat(acc["open"], F.array(F.struct(m["i"].alias("i"), m["name"].alias("name")))).alias("open"), acc["spans"].alias("spans"))
        closed = text.let(F.coalesce(at, F.lit(0)), lambda k: F.when(k == 0, acc).otherwise(F.struct(
            F.slice(acc["open"], 1, F.greatest(k - 1, F.lit(0))).alias("open"),
            F.concat(acc["spans"], ended(F.slice(acc["open"], F.greatest(k, F.lit(1)), F.size(acc["open"])), m["i"])).alias("spans"))))
        return F.when(m["closing"], closed).otherwise(opened)

    return text.let(
        F.aggregate(marks, start, step), lambda acc: F.array_sort(F.concat(acc["spans"], ended(acc["open"], F.size(tokens)))))


def _element(tokens: Column, span: Column, prefix: int) -> Column:
    tag = F.get(tokens, span["i"])
    inner = F.slice(tokens, span["i"] + 2, span["j"] - span["i"] - 1)
    pieces = F.filter(F.transform(inner, lambda t: t["text"]), lambda x: x != "")
    name = r"""(?is)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    has_class = tag["tag"].rlike(r"(?is)\sclass(?=[\s=>/])")
    return F.struct(
        tag["name"].alias("tag"),
        F.when(has_class, F.concat(*[F.regexp_extract(tag["tag"], name, k) for k in (1, 2, 3)])).alias("class"),
        F.exists(inner, lambda t: (t["name"] == "a") & ~t["closing"]).alias("link"),
        F.substring(F.array_join(pieces, ""), 1, prefix).alias("text"),
    )
