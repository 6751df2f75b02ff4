"""URL verdicts from rules and from a tree of path templates per host.

DataFrame expressions only. Paths are reduced to shapes in the row (numbers,
hex strings, dates and slugs become classes). The counts per (host, shape)
form a tree; level by level, segments that vary become wildcards, and sibling
branches whose subtrees look alike are merged. A template is rejected by the
smoothed purity of the labels (rule verdicts) of its pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.llm.common import LOWER, UPPER
from newspulse.session import settle

#: Fixed values of the query: (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 4  # levels of the tree; what is deeper forms one last segment
MIN_CHILDREN, RARE = 16, 0.02  # a parent with that many branches gives its rare ones a wildcard
DISTANCE = 0.25  # merge branches whose subtree shares differ by less (total variation)
Z = 2.58  # ... unless their label rates differ by more standard errors
PRIOR, STRENGTH = 0.1, 4.0  # purity before any label, and its weight in labels
UNLABELLED = 0.25  # weight of a page without label against a block
REJECT = 0.5


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    at = F.instr(c, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(c, at + 3, F.length(c))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.

    The list is a parameter of the job and becomes one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segment_class(s: Column) -> Column:
    """A segment, or the class of a segment that varies by its form."""
    ext = F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "{date}").when(stem.rlike(r"^\d+$"), "{num}")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{hex}")
        .when(stem.rlike(r"^[^-]*(-[^-]+){3,}$") | (F.length(stem) > 40), "{slug}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, ext)).otherwise(s)


def path_levels(path: Column) -> Column:
    """DEPTH classes of segments; the last one holds all deeper ones."""
    parts = F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), segment_class)
    deep = F.array_join(F.slice(parts, DEPTH, 1 << 30), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(deep))).otherwise(parts)


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])


def _generalise(tree: DataFrame, depth: int) -> DataFrame:
    """Give the rare branches of crowded parents a wildcard at ``depth``."""
    here = tree.where(F.size("t") > depth).select("host", F.slice("t", 1, depth).alias("p"), F.get("t", F.lit(depth)).alias("s"), "n")
    children = here.groupBy("host", "p", "s").agg(F.sum("n").alias("n"))
    parents = children.groupBy("host", "p").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("branches"))
    rare = children.join(parents, ["host", "p"]).where(
        (F.col("branches") >= MIN_CHILDREN) & (F.col("n") < RARE * F.col("total")) & ~F.col("s").startswith("{")
    ).select("host", "p", "s", F.lit("*").alias("to"))
    return _rename(tree, depth, rare)


def _rename(tree: DataFrame, depth: int, names: DataFrame) -> DataFrame:
    names = names.select(F.col("host").alias("h"), F.col("p"), F.col("s"), F.col("to"))
    on = (F.col("host") == F.col("h")) & (F.slice("t", 1, depth) == F.col("p")) & (F.get("t", F.lit(depth)) == F.col("s"))
    t = F.when(F.col("to").isNull(), F.col("t")).otherwise(
        F.concat(F.slice("t", 1, depth), F.array("to"), F.slice("t", depth + 2, 1 << 30)))
    return tree.join(names, on & (F.size("t") > depth), "left").select("host", "shape", t.alias("t"), "n", "labelled", "blocked")


def _merge(tree: DataFrame, depth: int) -> DataFrame:
    """Merge the branches at ``depth`` that look like their siblings together.

    A branch looks like them when the shares of the subtrees below it differ
    little from those of all branches pooled, and its label rate is within
    ``Z`` standard errors of the pooled one.
    """
    below = settle(_counts(tree.where(F.size("t") > depth + 1).select(
        "host", F.slice("t", 1, depth).alias("p"), F.get("t", F.lit(depth)).alias("s"),
        F.slice("t", depth + 2, 1 << 30).alias("sub"), "n", "labelled", "blocked"), "host", "p", "s", "sub"), "url-subtrees")
    branch = _counts(below, "host", "p", "s").select(
        "host", "p", "s", F.col("n").alias("bn"), F.col("labelled").alias("bl"), F.col("blocked").alias("bb"))
    pooled = _counts(below, "host", "p", "sub").select("host", "p", "sub", F.col("n").alias("pn"))
    parent = branch.groupBy("host", "p").agg(
        F.sum("bn").alias("n"), F.sum("bl").alias("l"), F.sum("bb").alias("b"), F.count(F.lit(1)).alias("branches"))
    # Half the sum of |a - b| over all subtrees is 1 - the sum of the smaller ones.
    common = below.join(branch, ["host", "p", "s"]).join(pooled, ["host", "p", "sub"]).join(
        parent.select("host", "p", F.col("n").alias("tn")), ["host", "p"]
    ).groupBy("host", "p", "s").agg(F.sum(F.least(F.col("n") / F.col("bn"), F.col("pn") / F.col("tn"))).alias("common"))
    rate = F.col("b") / F.greatest(F.col("l"), F.lit(1))
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) / F.greatest(F.col("bl"), F.lit(1)))
    alike = (F.col("bl") == 0) | (F.abs(F.col("bb") / F.greatest(F.col("bl"), F.lit(1)) - rate) <= Z * error)
    same = common.join(branch, ["host", "p", "s"]).join(parent, ["host", "p"]).where(
        (F.col("branches") > 1) & (1 - F.col("common") < DISTANCE) & alike
    ).select("host", "p", "s", F.lit("~").alias("to"))
    return _rename(tree, depth, same)


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) for (host, shape, label).

    Every shape of every host keeps its row; only counts are shuffled.
    """
    tree = pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
        F.coalesce(F.sum((F.col("label") == "block").cast("long")), F.lit(0)).alias("blocked"),
    ).withColumn("t", F.col("shape"))
    for depth in range(DEPTH):
        tree = settle(_generalise(tree, depth), "url-tree")
    for depth in reversed(range(DEPTH - 1)):
        tree = settle(_merge(tree, depth), "url-tree")
    total = _counts(tree, "host", "t").select(
        F.col("host").alias("h"), F.col("t").alias("tt"),
        ((F.col("blocked") + PRIOR * STRENGTH)
         / (F.col("labelled") + UNLABELLED * (F.col("n") - F.col("labelled")) + STRENGTH)).alias("purity"))
    return tree.join(total, (F.col("host") == F.col("h")) & (F.col("t") == F.col("tt"))).select(
        "host", "shape", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    The verdict is the longest fitting rule's; elsewhere ``block`` where the
    template's purity reaches REJECT, else ``allow``. Null urls, urls without
    ``://`` and repeated rows each give a row; null and malformed ones belong
    to the empty host. An empty table gives no rows. Other columns are not
    looked at.
    """
    host, path = split_url("url")
    rule, label = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select(
        "*", rule.alias("rule"), label.alias("label"), path_levels(F.col("path")).alias("shape"))
    found = settle(templates(rows), "url-templates").select(
        F.col("host").alias("h"), F.col("shape").alias("sh"), "template", "purity")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(found, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("sh")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity")
