"""File readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newspulse.sources import quoted_csv, schemas


def read_csv_table(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with quoted multi-line text; columns are found by the names in its header.

    Columns in another order are put in that of ``schema``, additional ones
    are left out, missing ones are null. A BOM is dropped; a value that does
    not fit its type is null. A UTF-8 file is read by many tasks; one in
    another encoding, whose line ends can't be told from its bytes, by one.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding)
    if encoding.upper().replace("-", "") == "UTF8":
        raw = quoted_csv.read(spark, path, raw.columns)
    names = {c.strip("\ufeff ").lower(): c for c in raw.columns}
    return raw.select(*[
        (F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(schema).fields
    ])


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.ARTICLE_RAW) -> DataFrame:
    """Article table; CSV, which needs three passes, is for exchange."""
    if fmt == "csv":
        return read_csv_table(spark, path, schema)
    return spark.read.format(fmt).schema(schema).load(path)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table, or an empty one when nothing is stored yet."""
    try:
        return read_articles(spark, path, fmt, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.FAILURE_LOG, timestampFormat="yyyy-MM-dd HH:mm:ss")


def read_prices(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.csv(path, schema=schemas.PRICE, header=True)
    return spark.read.format(fmt).schema(schemas.PRICE).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.HTML_PAGES).load(path)


def read_articles_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Stored articles of [start, end]; the store is partitioned by day."""
    days = spark.read.parquet(path)
    return days.where(F.col("date_only").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
