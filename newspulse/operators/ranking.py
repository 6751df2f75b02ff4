"""Top-k, first-per-key, global ranks and running totals without hot tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.session import settle

RANK_CHUNK = 10_000


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_name: str | None = None
) -> DataFrame:
    """The first ``k`` rows of every group.

    The rank limit runs before the shuffle too, so a hot group sends at most
    ``k`` rows per task.
    """
    name = rank_name or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)
    return out if rank_name else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One deterministic row per key; null keys form one group."""
    return top_k_per_group(df, keys, order, 1)


def rank_ranges(counts: DataFrame, count_col: str = "n") -> DataFrame:
    """(count, lo, hi): the ranks taken by all rows that share a count.

    The window runs over the distinct counts only; with T occurrences in all
    there are fewer than sqrt(2 T) of them.
    """
    sizes = counts.groupBy(F.col(count_col).alias("n")).agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("hi", F.sum("size").over(w)).select(
        "n", (F.col("hi") - F.col("size") + 1).alias("lo"), "hi"
    )


def expand_ranks(ranges: DataFrame, chunk: int = RANK_CHUNK) -> DataFrame:
    """One row per rank; a long range is cut into chunks spread over tasks."""
    step = F.lit(chunk).cast("long")
    chunks = ranges.select("n", "hi", F.explode(F.sequence("lo", "hi", step)).alias("from"))
    spread = chunks.repartition("n", "from")
    return spread.select(
        F.explode(F.sequence("from", F.least("hi", F.col("from") + step - 1))).alias("rank"), F.col("n").alias("freq")
    )


def running_totals(df: DataFrame, order: str, values: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Running sums over the whole table in ``order`` (unique), in two levels.

    Rows are range-partitioned into buckets, the buckets' totals are summed
    up in order, and each bucket adds its offset to its own running sums. No
    task sees more than one bucket. ``values`` maps value column to result
    column.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(
        df.repartitionByRange(n, order).withColumn("_bucket", F.spark_partition_id()), "running-totals"
    )
    totals = ranged.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values]
    )
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, "_bucket")
    return joined.select(
        *df.columns, *[(F.col(f"_before_{v}") + F.sum(v).over(inside)).alias(name) for v, name in values.items()]
    )
