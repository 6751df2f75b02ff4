"""Scores written to a database as a staging table.

The update by key then is one statement in the database, from staging into
the table; the same rule on DataFrames is ``operators.state.keyed_update``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_staging(scores: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, partitions: int = 32) -> None:
    (
        scores.select("id", "sentiment", "score")
        .repartition(partitions)  # an exchange, so that the scoring before it keeps its tasks
        .write.format("jdbc")
        .options(url=url, dbtable=table, createTableColumnTypes="sentiment VARCHAR(20)", **(properties or {}))
        .mode("overwrite")
        .save()
    )
