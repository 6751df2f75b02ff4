"""An append-only article store with one folder per micro-batch.

A batch that is run again overwrites its own folder and reads only folders
of earlier batches, so a replay leaves the same rows as a single run.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A parquet table, or None when its folder does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _struct(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def write_batch(df: DataFrame, root: str, batch_id: int, partition_by: str | None = None) -> None:
    """Overwrite one batch's folder.

    A partitioned write gathers each value's rows into few files; the
    rebalance splits a value that is too big for one task.
    """
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root}/batch={batch_id}")


def read_batch(spark: SparkSession, root: str, batch_id: int, schema: StructType | str) -> DataFrame:
    """One batch's rows; an empty table for the batch before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(_struct(schema)).parquet(f"{root}/batch={batch_id}")


def read_store(spark: SparkSession, root: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before a batch (folders are pruned)."""
    fields = _struct(schema)
    rows = read_if_present(spark, root, StructType(list(fields.fields)).add("batch", "long"))
    if rows is None:
        return spark.createDataFrame([], fields)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.select(*fields.fieldNames())


def rewrite_store(
    spark: SparkSession, root: str, new_root: str, schema: StructType | str, last_batch: int, partition_by: str | None = None
) -> None:
    """Copy a store's batches up to ``last_batch`` into one folder of a new root.

    For a stopped stream with many small folders. The stream goes on with the
    new root and its old checkpoint.
    """
    rows = read_store(spark, root, schema, before=last_batch + 1)
    write_batch(rows, new_root, last_batch, partition_by)


def guard_store(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Refuse a used store with a fresh checkpoint: batch numbers would restart."""
    used = read_if_present(spark, root, StructType()) is not None
    if used and read_if_present(spark, f"{checkpoint}/metadata", StructType()) is None:
        raise ValueError(f"{root} was filled under another checkpoint; give both a new folder or neither")
