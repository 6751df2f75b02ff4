"""Row generators that keep expensive expressions from being repeated.

The optimizer copies the input of ``explode`` into a size filter, and moves a
filter on a computed column below the projection that computes it. Both run
the expression again, even below an exchange. An outer generator gets no
such filter and stops filters above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, *keep: str | Column, array: Column | str, name: str) -> DataFrame:
    """One row per array element, none for an empty array."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def computed(df: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """Columns that later filters may use without running them again."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    names = [k if isinstance(k, str) else df.select(k).columns[0] for k in keep]
    out = df.select(*keep, F.explode_outer(packed).alias("_x"))
    return out.select(*names, *[F.col(f"_x.{name}").alias(name) for name in columns])
