"""Stratified sample for hand labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.operators.ranking import top_k_per_group
from newspulse.session import settle


def tagging_sample(
    articles: DataFrame,
    key: str,
    label: str = "sentiment",
    confidence: str = "confidence",
    quotas: dict[str, int] | None = None,
    seed: int = 42,
) -> DataFrame:
    """A numbered, shuffled sheet with a fixed quota of rows per label.

    Rows are drawn in the order of a hash of seed and key (unique), so the
    draw is uniform and repeatable. A class smaller than its quota gives
    what it has; ``quota_met`` tells. The draw ranks keys and labels only;
    the texts are then looked up for the drawn keys, which the quotas bound.
    """
    quotas = quotas or fixed.SAMPLE_QUOTAS
    limit = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    hashed = lambda step: F.md5(F.concat(F.lit(f"{seed}|{step}|"), F.col(key).cast("string")))
    narrow = articles.where(F.col(label).isin(list(quotas))).select(
        key, F.col(label).alias("predicted"), hashed("draw").alias("_draw")
    )
    drawn = top_k_per_group(narrow, ["predicted"], [F.asc("_draw"), F.asc(key)], max(quotas.values()), "_rank").where(
        F.col("_rank") <= limit[F.col("predicted")]
    )
    sheet = drawn.select(
        key,
        F.row_number().over(Window.orderBy(hashed("shuffle"), key)).cast("long").alias("number"),
        "predicted",
        (F.count(F.lit(1)).over(Window.partitionBy("predicted")) == limit[F.col("predicted")]).alias("quota_met"),
    )
    # A table of known size, so that it is broadcast only if it is small.
    return articles.join(settle(sheet, "tagging-sheet"), key).select(
        "number", key, "title", F.substring("content", 1, fixed.BODY_PREFIX).alias("body_start"), "predicted",
        F.col(confidence).alias("confidence"), F.lit("").alias("hand_label"), F.lit("").alias("match"), "quota_met",
    )
