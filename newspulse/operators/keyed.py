"""Stored tables that take a batch without being rewritten or shuffled.

``update_days`` changes rows of a table that is partitioned by day and writes
only the days it touches. A *keyed table* is bucketed and sorted by its key:
a batch is appended to its buckets with a version, and joins and look-ups by
the key read the table where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newspulse.operators.ranking import first_per_key
from newspulse.operators.state import keyed_update
from newspulse.session import settle

VERSION = "_version"


def update_days(
    spark: SparkSession, path: str, schema: StructType, changes: DataFrame, key: str, columns: Sequence[str],
    order: Sequence[Column] | None = None, day: str = "date_only",
) -> DataFrame:
    """Set ``columns`` by key in a table of ``schema`` that is partitioned by ``day``; returns the table.

    The rule is that of ``keyed_update``. Only days that hold a changed key
    are read whole and written again. They are known from ``changes`` if it
    has the day, else from the table's key column. Columns that the table
    does not have yet are null on the other days. The new rows are settled
    before they replace the old ones, so a failed update can be run again.
    """
    stored = spark.read.schema(schema).parquet(path)
    picked = settle(first_per_key(changes, [key], order or [F.col(c).desc_nulls_last() for c in columns]), "keyed-changes")
    if day in changes.columns:
        days = picked.select(day)
    else:
        days = stored.select(key, day).join(picked.select(key), key, "left_semi").select(day)
    touched = [r[0] for r in days.distinct().collect()]  # one value a day
    added = [f for f in picked.schema if f.name in columns and f.name not in schema.fieldNames()]
    wide = StructType([f for f in schema if f.name != day] + added + [schema[day]])
    if touched:
        hit = F.col(day).isin([d for d in touched if d is not None])
        if None in touched:
            hit = hit | F.col(day).isNull()
        fresh = keyed_update(stored.where(hit), picked.drop(day), key, columns)
        fresh = settle(fresh.select(*wide.fieldNames()), "updated-days")
        fresh.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return spark.read.schema(wide).parquet(path)


def create_table(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Make a keyed table of ``rows`` (version 0) with one file a bucket; ``buckets`` should not be below
    ``spark.sql.shuffle.partitions``, as Spark would shuffle it for more parallel tasks."""
    _write(rows, 0, name, path, key, buckets, "overwrite")


def append_batch(rows: DataFrame, version: int, name: str, path: str, key: str, buckets: int) -> None:
    """Add a batch to the buckets of its keys; stored files stay as they are."""
    _write(rows, version, name, path, key, buckets, "append")


def _write(rows: DataFrame, version: int, name: str, path: str, key: str, buckets: int, mode: str) -> None:
    dealt = rows.withColumn(VERSION, F.lit(version)).repartition(buckets, key)
    dealt.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def current(spark: SparkSession, name: str, order: Sequence[Column], key: str = "url") -> DataFrame:
    """The newest row of every key of a keyed table, the first in ``order`` of one version.

    The buckets hold all rows of a key, so nothing is shuffled. A missing
    key is one key.
    """
    return first_per_key(spark.table(name), [key], [F.desc(VERSION), *order]).drop(VERSION)


def unknown_rows(batch: DataFrame, name: str, order: Sequence[Column], key: str = "url") -> DataFrame:
    """Rows of ``batch`` whose key is not in a keyed table, one per key; missing keys count as equal.

    Only the batch is shuffled. Keys are compared by plain equality, which
    the buckets serve; whether a missing key is stored is asked separately.
    """
    stored = batch.sparkSession.table(name)
    fresh = first_per_key(batch, [key], order)
    if not stored.where(F.col(key).isNull()).select(key).limit(1).isEmpty():
        fresh = fresh.where(F.col(key).isNotNull())
    known = stored.select(F.col(key).alias("_known"))
    return fresh.join(known, F.col(key) == F.col("_known"), "left_anti")
