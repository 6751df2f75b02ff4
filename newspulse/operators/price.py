"""Daily signal against a price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def price_series(
    prices: DataFrame, day: str = "Date", close: str = "Close", start: str | None = None, end: str | None = None
) -> DataFrame:
    """(date_only, close) inside [start, end)."""
    out = prices
    if start:
        out = out.where(F.col(day) >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col(day) < F.lit(end).cast("date"))
    return out.select(F.col(day).cast("date").alias("date_only"), F.col(close).cast("double").alias("close"))


def signal_price(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Days with both values, next-step return and change of sentiment.

    Both sides hold one row per day.
    """
    w = Window.orderBy("date_only")
    joined = daily.select("date_only", "sentiment_mean").join(prices, "date_only")
    return joined.withColumn("stock_change", F.lead("close").over(w) / F.col("close") - 1).withColumn(
        "sentiment_change", F.col("sentiment_mean") - F.lag("sentiment_mean").over(w)
    )


def signal_price_corr(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count(F.lit(1)).alias("days"), F.corr("sentiment_mean", "stock_change").alias("correlation")
    )
