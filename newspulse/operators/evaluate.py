"""Label distribution and evaluation against hand labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.session import settle


def label_distribution(articles: DataFrame, label: str, confidence: str | None = None) -> DataFrame:
    """Rows and share of all rows per label; rows without label count in the total."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if confidence:
        aggs += [F.sum(confidence).alias("_sum"), F.count(confidence).alias("_known")]
    everything = Window.partitionBy()
    grouped = articles.groupBy(F.col(label).alias("label")).agg(*aggs)
    out = grouped.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(everything))
    if confidence:
        mean = F.try_divide(F.sum("_sum").over(everything), F.sum("_known").over(everything))
        out = out.withColumn("mean_confidence", mean).drop("_sum", "_known")
    return out.where(F.col("label").isNotNull())


def _label_pairs(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    return (
        predictions.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_report(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then the three summaries.

    Everything after the first aggregate works on one row per label pair.
    """
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = _label_pairs(predictions, truth, predicted).select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                         hit.cast("long").alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("x")
    ).select("x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    classes = (
        sides.groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])
        .withColumn("precision", ratio(F.col("hits"), F.col("claimed")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    measures = ["precision", "recall", "f1"]
    support = F.sum("support")
    one_row = classes.agg(
        F.struct(
            F.lit("accuracy").alias("label"), *[(F.sum("hits") / support).alias(m) for m in measures],
            support.alias("support"),
        ).alias("a"),
        F.struct(
            F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], support.alias("support")
        ).alias("m"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures],
            support.alias("support"),
        ).alias("w"),
    )
    summaries = one_row.select(F.explode(F.array("a", "m", "w")).alias("x")).select("x.*")
    return classes.select("label", *measures, "support").unionByName(summaries)


def confusion_matrix(
    predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str] | None = None
) -> DataFrame:
    """Counts, one row per true class and one column per predicted class.

    The classes are the labels found on either side, in order, together with
    ``classes``; no pair is left out. The driver sees the labels only, from
    the counts per pair. Pairs with a null on either side don't count.
    """
    spark = predictions.sparkSession
    counted = settle(_label_pairs(predictions, truth, predicted), "label-pairs")
    found = {r.x for r in counted.select(F.explode(F.array("t", "p")).alias("x")).distinct().collect()}
    classes = sorted(found | set(classes or ()))
    every = spark.createDataFrame([(c,) for c in classes], "t string").select(
        "t", F.col("t").alias("p"), F.lit(0).cast("long").alias("n")
    )
    pairs = counted.unionByName(every)
    cells = [F.coalesce(F.sum(F.when(F.col("p") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    return pairs.groupBy(F.col("t").alias("true_label")).agg(*cells)
