"""File writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; quotes are doubled and text keeps its outer blanks.

    Array columns are joined with a space, since CSV has no arrays.
    """
    arrays = [name for name, kind in df.dtypes if kind.startswith("array")]
    flat = df.select(*[F.array_join(c, " ").alias(c) if c in arrays else F.col(c) for c in df.columns])
    flat.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', escapeQuotes=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def append_failure_log(rejects: DataFrame, path: str) -> None:
    """Append (time, url, reason) rows, tab separated."""
    rejects.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ts"), "url", "reason").write.mode(
        "append"
    ).csv(path, sep="\t")
