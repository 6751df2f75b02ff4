"""Database tables as sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

NEWS_COLUMNS = ("ID", "TITLE", "CONTENT")


def project(table: DataFrame, columns: Sequence[str] = NEWS_COLUMNS) -> DataFrame:
    return table.select(*columns)


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str] = NEWS_COLUMNS,
    key: str = "ID",
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Chosen columns of a table, read in parallel over ranges of the key.

    Without ``bounds`` the database is asked for the smallest and the largest
    key first; an empty table is read by one task. Ranges are equally wide, or
    with ``balanced`` hold about as many rows each, for which the database
    counts rows per range first.
    """
    reader = spark.read.format("jdbc").options(url=url, **(properties or {}))
    if bounds is None:
        ends = reader.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
        bounds = None if ends[0] is None else (int(ends[0]), int(ends[1]))
    if balanced and bounds is not None:

        def count(lo: int, hi: int, width: int) -> list[tuple[int, int]]:
            rows = reader.option("query", histogram_sql(table, key, lo, hi, width)).load().collect()
            return [(int(r[0]), int(r[1])) for r in rows]

        ranges = predicates(key, equal_depth(count, bounds[0], bounds[1] + 1, partitions))
        return project(spark.read.jdbc(url, table, predicates=ranges, properties=properties), columns)
    return project(reader.options(dbtable=table, **partition_options(key, bounds, partitions)).load(), columns)


def histogram_sql(table: str, key: str, lo: int, hi: int, width: int) -> str:
    """Rows per range of ``width`` keys from ``lo`` to below ``hi``: (number of the range, rows)."""
    part = f"FLOOR(({key} - {lo}) / {width}.0)"
    return f"SELECT {part} AS part, COUNT(*) AS n FROM {table} WHERE {key} >= {lo} AND {key} < {hi} GROUP BY {part}"


def equal_depth(count: Callable[[int, int, int], list[tuple[int, int]]], lo: int, hi: int, partitions: int, fine: int = 16) -> list[int]:
    """Bounds of at most ``partitions`` ranges of [lo, hi) with about as many rows each.

    ``count(lo, hi, width)`` gives rows per range of ``width`` keys, without
    the empty ones. The first histogram has ``fine`` ranges a partition; a
    range that alone holds more than a ``fine``-th of a partition's rows is counted again in
    narrower ones, until that no longer helps. Every histogram has at most
    ``fine * partitions`` rows.
    """
    most = fine * partitions

    def histogram(a: int, b: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(b - a) // most))
        return sorted((a + k * width, min(b, a + (k + 1) * width), n) for k, n in count(a, b, width))

    cells = histogram(lo, hi)
    total = sum(n for _, _, n in cells)
    if not total:
        return [lo, hi]
    share = total / partitions
    while any(n > share / fine and b - a > 1 for a, b, n in cells):
        large = [c for c in cells if c[2] > share / fine and c[1] - c[0] > 1]
        finer = [cell for a, b, _ in large for cell in histogram(a, b)]
        kept = [c for c in cells if c not in set(large)]
        if len(finer) + len(kept) > 64 * most:
            break
        cells = sorted(kept + finer)
    bounds, seen = [lo], 0
    for a, _, n in cells:
        # A cell goes where most of it belongs.
        while len(bounds) < partitions and seen + n / 2 >= share * len(bounds):
            if a > bounds[-1]:
                bounds.append(a)
            else:
                break
        seen += n
    return [*bounds, hi]


def predicates(key: str, bounds: Sequence[int]) -> list[str]:
    """One condition a range; together they hold for every row once, rows without a key in the first."""
    inner = list(bounds[1:-1])
    if not inner:
        return ["1 = 1"]
    first = f"{key} < {inner[0]} OR {key} IS NULL"
    return [first, *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(inner, inner[1:], strict=False)), f"{key} >= {inner[-1]}"]


def partition_options(key: str, bounds: tuple[int, int] | None, partitions: int) -> dict[str, str]:
    """Reader options for ranges of the key; the upper bound is exclusive."""
    if bounds is None:
        return {}
    return {
        "partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1] + 1),
        "numPartitions": str(max(1, min(partitions, bounds[1] - bounds[0] + 1))),
    }
