"""Stored articles: anti join, append, upsert, keyed update, label join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.operators.ranking import first_per_key
from newspulse.session import settle


def new_articles(incoming: DataFrame, stored: DataFrame, order: Sequence[Column], key: str = "url") -> DataFrame:
    """Incoming rows whose key is not stored, one per key.

    The batch is reduced to one row per key first, so a hot or missing key
    is a single row when it meets the store. Missing keys count as equal.
    """
    batch = first_per_key(incoming, [key], order)
    known = stored.select(F.col(key).alias("_known"))
    return batch.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def known_keys(incoming: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """The incoming keys that are stored: what ``new_articles`` needs to know.

    For a small batch against a large store. The batch's keys are settled,
    so the planner broadcasts them when they fit and the store's keys are
    scanned where they lie instead of being shuffled.
    """
    keys = settle(incoming.select(F.col(key).alias("_key")).distinct(), "incoming-keys")
    hits = stored.select(key).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return settle(hits.distinct(), "known-keys")


def append_rows(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    order: Sequence[Column],
    key: str = "url",
    sort_by: str | None = "date",
    stored_is_unique: bool = False,
) -> DataFrame:
    """Newest row per key, then sorted by date descending.

    Incoming rows win over stored ones; inside a side the first in ``order``
    wins. A missing key is one key. A store that holds each key once (as
    this operator leaves it) only has to drop the replaced rows, which needs
    no shuffle of the store when the incoming keys are few.
    """
    if stored_is_unique:
        fresh = first_per_key(incoming, [key], order)
        replaced = settle(incoming.select(F.col(key).alias("_key")).distinct(), "incoming-keys")
        untouched = stored.join(replaced, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        merged = untouched.unionByName(fresh, allowMissingColumns=True)
        return merged.orderBy(F.desc(sort_by), F.asc(key)) if sort_by else merged
    both = stored.withColumn("_version", F.lit(0)).unionByName(
        incoming.withColumn("_version", F.lit(1)), allowMissingColumns=True
    )
    newest = first_per_key(both, [key], [F.desc("_version"), *order]).drop("_version")
    return newest.orderBy(F.desc(sort_by), F.asc(key)) if sort_by else newest


def keyed_update(
    table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """Set columns by key; unmatched rows keep theirs, absent columns are added.

    Of several changes of a key the first in ``order`` holds (by default that
    with the largest values), so the table keeps its rows.
    """
    changes = first_per_key(changes, [key], order or [F.col(c).desc_nulls_last() for c in columns])
    types = dict(changes.dtypes)
    base = table
    for c in columns:
        if c not in table.columns:
            base = base.withColumn(c, F.lit(None).cast(types[c]))
    news = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(news, key, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def attach_labels(articles: DataFrame, labels: DataFrame, key: str = "url") -> DataFrame:
    """Left join of labels by key; the key is unique in ``labels``."""
    return articles.join(labels, key, "left")
