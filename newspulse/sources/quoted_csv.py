"""Quoted multi-line CSV, one file read by many tasks.

Spark cuts a file into byte ranges and hands each task the lines that start
in its range. Whether a line starts inside a quoted field depends on all
lines before it, so three passes are made:

1. every range tells in which state it ends for both states it can start in;
2. these transitions are composed in file order, which gives each range its
   true start; the pieces of records that cross an edge, at most two a range,
   are written and put together;
3. every range emits the records that start and end in it.

All passes read lines where they lie; only the pieces of pass 2 are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newspulse.session import settle

WHERE = "file string, block long"
#: Ranges of one table that start inside a quoted field; they are broadcast, 30 bytes and a path each.
MOST_OPEN = 1_000_000


def ends_inside(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its start.

    A quote opens a field only as its first character; a doubled quote inside
    stands for one; what follows a closing quote is plain up to the separator.
    """
    if quote not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            close = line.find(quote, at)
            while close >= 0 and line[close + 1 : close + 2] == quote:
                close = line.find(quote, close + 2)
            if close < 0:
                return True
            at = close + 1
        elif line[at : at + 1] == quote:
            inside, at = True, at + 1
            continue
        inside = False
        at = line.find(sep, at) + 1
        if not at or at > n:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ranges(frames: Iterable[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """(file, block, values...) of every line, in the order of the scan."""
    for frame in frames:
        yield from zip(frame["file"], frame["block"], *(frame[c] for c in columns), strict=True)


def transitions(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """(file, block, closed, open): is a field open at the range's end, if none or one is at its start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[tuple, list[bool]] = {}
        for file, block, line in _ranges(frames, "value"):
            state = ends.setdefault((file, block), [False, True])
            if quote in line:
                state[:] = [ends_inside(line, s, sep, quote) for s in state]
        yield pd.DataFrame([(*k, *v) for k, v in ends.items()], columns=["file", "block", "closed", "open"])

    return lines.mapInPandas(run, f"{WHERE}, closed boolean, open boolean")


def open_ranges(ends: DataFrame) -> DataFrame:
    """(file, block) of the ranges that start inside a quoted field.

    A group is the ranges of one file, one small row per range.
    """
    step = F.struct("block", "closed", "open")
    start = F.struct(F.lit(False).alias("state"), F.array().cast("array<bigint>").alias("inside"))
    fold = F.aggregate("ranges", start, lambda acc, r: F.struct(
        F.when(acc["state"], r["open"]).otherwise(r["closed"]).alias("state"),
        F.when(acc["state"], F.concat(acc["inside"], F.array(r["block"]))).otherwise(acc["inside"]).alias("inside")))
    files = ends.groupBy("file").agg(F.array_sort(F.collect_list(step)).alias("ranges"))
    return files.select("file", F.explode(fold["inside"]).alias("block"))


def records(lines: DataFrame, inside: DataFrame, sep: str, quote: str, edges: bool) -> DataFrame:
    """(file, block, part, record, header): the whole records of every range, or the pieces at its edges.

    A piece has part 0 if an earlier range begins its record, else 1; a range
    that lies inside one record is one piece 0. ``header`` marks the first
    record of a file that isn't empty, or its first piece.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "block", "part", "record", "header"]
        out: list[tuple] = []
        here, state, held, head, first = None, False, [], False, False

        def emit() -> None:
            out.append((*here, 0 if head else 1, "\n".join(held).removesuffix("\r" if not state else ""), first and not head))

        for file, block, line, starts_inside in _ranges(frames, "value", "starts_inside"):
            if (file, block) != here:
                if held and edges:  # the range is over in the middle of a record
                    emit()
                head = bool(starts_inside)
                here, state, held, first = (file, block), head, [], block == 0
            state = ends_inside(line, state, sep, quote)
            held.append(line)
            if not state:
                if head == edges:
                    emit()
                first = first and held == [""]
                held, head = [], False
                if len(out) >= 2_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if held and edges:
            emit()
        yield pd.DataFrame(out, columns=columns)

    known = lines.join(F.broadcast(inside.withColumn("starts_inside", F.lit(True))), ["file", "block"], "left")
    return known.select("file", "block", "value", "starts_inside").mapInPandas(
        run, f"{WHERE}, part int, record string, header boolean")


def stitched(pieces: DataFrame) -> DataFrame:
    """(record, header) from pieces at edges: a piece 1 and the pieces 0 that follow it in its file.

    A file that ends inside a quoted field gives the rest as one record.
    """
    order = Window.partitionBy("file").orderBy("block", "part")
    begin = F.max(F.when(F.col("part") == 1, F.col("block"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = pieces.withColumn("begin", begin).groupBy("file", "begin").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("p"), F.max("header").alias("header"))
    return whole.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), "header")


def read_records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """(record, header): every record of UTF-8 CSV files as text; ``header`` marks the first of each file.

    Line ends inside quoted fields stay as they are; a CR at the end of a record is dropped.
    """
    lines = _lines(spark, path)
    ends = settle(transitions(lines, sep, quote), "csv-transitions")
    inside = settle(open_ranges(ends), "csv-open-ranges")
    if (n := inside.count()) > MOST_OPEN:
        raise ValueError(f"{n} ranges start inside a quoted field; raise spark.sql.files.maxPartitionBytes")
    pieces = settle(records(lines, inside, sep, quote, edges=True), "csv-edges")
    return records(lines, inside, sep, quote, edges=False).select("record", "header").unionByName(stitched(pieces))


def read(spark: SparkSession, path: str, header: list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """String columns in the order of ``header``; the header of each file and empty records are left out."""
    rows = read_records(spark, path, sep, quote).where("NOT header AND record <> ''")
    fields = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = rows.select(F.from_csv("record", fields, {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(header)])
