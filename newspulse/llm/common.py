"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: str | Column, modulus: int, rest: int) -> Column:
    """True where the id belongs to the held-out fold; a null id never does."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than ASCII white space."""
    return utf8(text).lower().split()


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside hands tasks at most ``rows`` rows at a time; wide rows fill their memory otherwise."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def slices(frames: Iterable[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``limit`` characters of ``column``."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        piece = np.cumsum(sizes) // limit
        if not len(piece) or piece[0] == piece[-1]:
            yield frame
            continue
        for _, part in frame.groupby(piece, sort=True):
            yield part


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    high = np.empty_like(x)
    for _ in range(2):
        np.right_shift(x, np.uint64(32), out=high)
        x ^= high
        x *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(x, np.uint64(32), out=high)
    x ^= high
    return x
