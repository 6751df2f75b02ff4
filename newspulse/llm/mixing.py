"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time. Its integral is the
source's share of all tokens; its running integral says how many of the
source's tokens are due by any time. A document's place in its source's token
stream is turned into a training position by inverting that running integral,
and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Knots (time, relative weight) of the schedule of each weight class: heavy
#: sources fade out, light ones fade in. Scaled to integral 1 before use.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.7, 1.0), (1.0, 2.0)),
)
MAX_REPEATS = 3
ROWS_PER_BUCKET = 10_000


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which ``share`` of a schedule's integral is used up."""
    parts = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        parts.append((t0, w0, t1 - t0, (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0)))
    whole = sum(p[-1] for p in parts)
    out, done = F.lit(knots[-1][0]), whole
    for t0, w0, _, slope, area in reversed(parts):
        done -= area
        due = F.greatest(share * whole - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * due, F.lit(0.0)))
        out = F.when(share * whole <= done + area, F.lit(t0) + 2 * due / (F.lit(w0) + root)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_rows, weight_class, target, mix_size) for (source, size).

    Weights repeat over the sources in code-point order, null last. ``share``
    of all sizes is dealt out by weight; a target stops at ``max_repeats``
    times its source's size and the excess goes to the others by weight. The
    level of weight at which this settles is found from the running sums over
    the sources in the order in which they reach their limit. The windows see
    one row per source, of which a mix has few.
    """
    per = sizes.groupBy("source").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("weight_class", (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("weight_class").cast("int") + 1)
    per = per.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    by_limit = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.coalesce(F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (total - before) / rest)
    # Levels fall from the first source that stays below its limit onwards.
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(Window.partitionBy())
    target = F.least(F.col("_cap"), F.greatest(F.coalesce(level * F.col("_w"), F.col("_cap")), F.lit(0.0)))
    out = per.select("source", "source_size", "n_rows", "weight_class", target.alias("target"))
    return out.withColumn("mix_size", F.sum("target").over(Window.partitionBy()))


def mix(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES,
        share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: what the mix takes of it and when.

    Columns: doc_id, source, size (words), source_size, target, taken (words,
    repeats counted), passes (whole and started reads), position (training
    time of the first read times the words of the mix; null if not taken).
    A source's words are laid out in an order drawn from ``seed``; its target
    is met to the word, as the last read of the last document may be partial.

    Null text counts as no words, null source is a source of its own and comes
    last; a null doc_id is a document like another. Repeated rows are taken
    one after the other. An empty table gives no rows. Other columns are not
    looked at.
    """
    sized = settle(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes")
    targets = settle(source_targets(sized, weights, share, max_repeats), "mix-targets")
    order = F.xxhash64("doc_id", F.lit(seed))
    unit = (F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53)))
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.mix_size", "t.weight_class", order.alias("_order"),
        F.floor(unit * F.ceil(F.col("t.n_rows") / ROWS_PER_BUCKET)).alias("_bucket"))
    # Two levels: words per bucket of the order, then words inside a bucket.
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    start = F.sum("_words").over(
        Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                             F.coalesce(start, F.lit(0)).alias("_start"))
    inside = F.sum("size").over(Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size")
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(
        buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    at = F.col("_start") + F.col("_inside")
    due = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least("size", due - whole * F.col("source_size") - at))
    placed = placed.select(
        "*", (whole * F.col("size") + part).cast("long").alias("taken"),
        (whole + (part > 0).cast("long")).alias("_reads"),
        F.when(F.col("target") > 0, at / F.col("target")).alias("_share"))
    time = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        time = F.when(F.col("weight_class") % len(schedules) == k, time_of(F.col("_share"), knots)).otherwise(time)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.when(F.col("size") > 0, F.col("_reads")).otherwise(0).alias("passes"),
        F.when(F.col("taken") > 0, time * F.col("mix_size")).alias("position"))


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents not taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
