"""Runs of periodic words in documents, tile by tile.

A run of period q and length n gives a stretch of n - q places that equal the
place q words on. For every octave of periods, P <= q < 2P, a document has
boundaries P words apart, each with a tile of P words before it and 3P words
after it. Z-functions of the tile, forwards and backwards from the boundary,
give the part of the stretch that lies within P words of the boundary for all
periods of the octave at once. A run of three periods or more has a stretch of
at least 2P, so it shows at every boundary it touches, and the parts of
neighbouring boundaries overlap. They are brought together by document and
period and stitched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.llm.common import mix64, slices, utf8
from newspulse.llm.hashing import _powers
from newspulse.session import settle

WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least this many words and this many periods. Smaller values need closer boundaries.
LEAST, TIMES = 24, 3
BASE_OCTAVE = 8  # periods below it share one octave with boundaries this far apart
RUNS = "array<struct<start:long,length:long,period:long>>"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents repeat their own words to the end.

    With h the crc32 of the id and g = h div 10, documents with h mod 10 = 0
    go on after word a = g mod n with words a, a+1, ... a+p-1 over and over,
    p = 1 + (n - a) div (3 + g mod 8). A null id or text stays as it is.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    a = F.when(n > 0, g % n)
    rows = chosen.select("*", a.alias("a"), g.alias("g"), n.alias("n"))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    again = F.expr("transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE get(w, int(a + (i - a) % p)) END)")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def octaves(n: int) -> Iterator[tuple[int, int]]:
    """(first period, distance of boundaries) of the octaves of a text of ``n`` words."""
    if n >= LEAST:
        yield 1, BASE_OCTAVE
    p = BASE_OCTAVE
    while TIMES * p <= n:
        yield p, p
        p *= 2


def promising(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first period, boundary) of the tiles that can hold part of a run.

    ``ids`` are the words of many texts one after the other, text t at
    ``first[t]`` with ``size[t]`` words. Of the parts on the two sides of a
    boundary one has half the boundaries' distance at least, so a hash of that
    many words before or after it must come again at a distance in the octave.
    """
    power, inverse = _powers(1 << max(12, int(len(ids)).bit_length()))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)], out=sums[1:])
    out = [(np.empty(0, np.int64),) * 3]
    for period, step in octaves(int(size.max(initial=0))):
        far = max(LEAST, TIMES * period)
        texts = np.flatnonzero(size >= far)
        m, last = step // 2, 2 * period - 1 if period > 1 else BASE_OCTAVE - 1
        if len(ids) < m:
            continue
        h = mix64((sums[m:] - sums[: len(sums) - m]) * inverse[: len(sums) - m])
        count = (size[texts] - period) // step + 1  # boundaries 0, step, ...
        text = np.repeat(texts, count)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
        for side in (0, m):  # after the boundary, and before it
            a = at - side
            ok = (a >= 0) & (a + period + m <= size[text])
            t, a = text[ok], a[ok]
            lanes = np.arange(period, last + 1)
            for k in range(0, len(t), block := max(1, (1 << 20) // len(lanes))):
                tt, aa = t[k : k + block], a[k : k + block]
                start = first[tt] + aa
                ask = start[:, None] + lanes
                same = (h[np.minimum(ask, len(h) - 1)] == h[start][:, None]) & (ask + m <= (first[tt] + size[tt])[:, None])
                hit = same.any(axis=1)
                out.append((tt[hit], np.full(hit.sum(), period), aa[hit] + side))
    found = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def solve(before: list[int], after: list[int], period: int, step: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi) of the parts of runs around a boundary, relative to it.

    A word is told from the one ``period`` words on in [lo, hi). Parts shorter
    than ``step`` are no part of a run, or less than a neighbour's. Periods
    whose word block is a power of a shorter one are left out: a run around it
    has the shorter period.
    """
    ahead = z_function(after)
    end = 2 * period if period > 1 else BASE_OCTAVE
    near = after[:end]
    back = z_function(before[::-1] + [-1] + near[::-1] + before[::-1])
    top = len(before) + 1 + len(near)  # where the words before the boundary start in it
    out = []
    for q in range(period, min(end, len(after) + 1)):
        f = min(ahead[q], step) if q < len(after) else 0
        b = min(back[top - q], step) if before else 0
        if f + b >= step and not any(ahead[q // p] >= q - q // p for p in _primes(q)):
            out.append((q, -b, f))
    return out


def _first_pass(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, plain, text, tiles): what each text is without runs, and where runs can be.

    ``plain`` is the hash of its words joined by single blanks; ``text`` is
    null where there is no promising tile.
    """
    schema = "row long, doc_id long, n long, plain string, text binary, tiles array<struct<p:int,c:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 2_000_000):
            words = [utf8(t).split() for t in frame["text"]]
            size = np.array([len(w) for w in words], np.int64)
            first = np.cumsum(size) - size
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(x, len(known)) for w in words for x in w], np.int64)
            tiles: list[list[dict]] = [[] for _ in words]
            for t, p, c in zip(*(x.tolist() for x in promising(ids, first, size)), strict=True):
                tiles[t].append({"p": p, "c": c})
            joined = [b" ".join(w) for w in words]
            out = pd.DataFrame({
                "row": frame["row"].to_numpy(), "doc_id": frame["doc_id"].astype("Int64").to_numpy(), "n": size,
                "plain": [hashlib.sha256(j).hexdigest() for j in joined],
                "text": [j if t else None for j, t in zip(joined, tiles, strict=True)],
                "tiles": [t or None for t in tiles]})
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(run, schema)


def _tiles(flagged: DataFrame) -> DataFrame:
    """(row, p, c, before, after): each promising tile with its own words as numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, text, tiles in zip(frame["row"], frame["text"], frame["tiles"], strict=True):
                words = bytes(text).split()
                known: dict[bytes, int] = {}
                ids = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
                out = []
                for tile in tiles:
                    p, c = tile["p"], tile["c"]
                    step = p if p > 1 else BASE_OCTAVE
                    out.append((row, p, c, ids[max(0, c - step) : c].tobytes(), ids[c : c + 3 * step].tobytes()))
                    if len(out) * step > 100_000:
                        yield pd.DataFrame(out, columns=["row", "p", "c", "before", "after"])
                        out = []
                yield pd.DataFrame(out, columns=["row", "p", "c", "before", "after"])

    return flagged.select("row", "text", "tiles").mapInPandas(run, "row long, p int, c int, before binary, after binary")


def _parts(tiles: DataFrame) -> DataFrame:
    """(row, q, lo, hi) of every tile."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, p, c, before, after in zip(*(frame[x] for x in ("row", "p", "c", "before", "after")), strict=True):
                numbers = [np.frombuffer(x, np.int32).tolist() for x in (before, after)]
                out += [(row, q, c + lo, c + hi) for q, lo, hi in solve(*numbers, p, p if p > 1 else BASE_OCTAVE)]
            yield pd.DataFrame(out, columns=["row", "q", "lo", "hi"])

    return tiles.mapInPandas(run, "row long, q int, lo int, hi int")


def _stitched(parts: DataFrame) -> DataFrame:
    """(row, q, lo, hi): maximal intervals from those that overlap or touch."""
    ordered = Window.partitionBy("row", "q").orderBy("lo", "hi")
    reached = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("new", F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int"))
    island = fresh.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("row", "q", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): every row as ``_first_pass`` gives it, and (row, runs) of those with a run.

    ``runs`` is an array of (start, length, period) by start, then period.
    """
    base = settle(_first_pass(docs), "periodic-texts")
    # A long text has many tiles: they are dealt out, so that it isn't one task's work.
    tiles = _tiles(base.where(F.col("text").isNotNull())).repartition("row", "p", "c")
    each = _stitched(_parts(tiles)).select(
        "row", F.col("lo").cast("long").alias("start"), F.col("q").cast("long").alias("period"),
        (F.col("hi") - F.col("lo") + F.col("q")).cast("long").alias("length"))
    long_enough = (F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))
    placed = each.where(long_enough).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    runs = placed.select("row", F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    return base, settle(runs, "periodic-runs")


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text, collapsed_sha256) for every row of (doc_id, text).

    A run is a maximal stretch of words of smallest period q with at least
    LEAST words and TIMES * q words. ``runs`` has (start, length, period) by
    start, then period. ``text`` is what is left, as bytes, when the words of
    every run after its first period are dropped; null where there is no run.
    Words are joined by one blank. Null text counts as empty, a null or
    repeated id gives a row like any other, an empty table none. Other
    columns are not looked at.
    """
    base, runs = find(docs)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, some in zip(frame["text"], frame["runs"], strict=True):
                words = bytes(text).split()
                gone = np.zeros(len(words), bool)
                for r in some:
                    gone[r["start"] + r["period"] : r["start"] + r["length"]] = True
                left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append((left, hashlib.sha256(left).hexdigest()))
            done = pd.DataFrame(out, columns=["text", "collapsed_sha256"])
            yield pd.concat([frame[["doc_id", "n", "runs"]].astype({"doc_id": "Int64"}).reset_index(drop=True), done], axis=1)

    none = F.array().cast(RUNS)
    plain = lambda df: df.select(
        "doc_id", F.col("n").alias("n_words"), none.alias("runs"), F.lit(None).cast("binary").alias("text"), F.col("plain").alias("collapsed_sha256"))
    flagged = base.where(F.col("text").isNotNull())
    # Only texts with a promising tile meet the runs; the others are done.
    some = flagged.join(runs, "row").select("doc_id", "n", "text", "runs").mapInPandas(
        cut, f"doc_id long, n long, runs {RUNS}, text binary, collapsed_sha256 string").withColumnRenamed("n", "n_words")
    return plain(base.where(F.col("text").isNull())).unionByName(plain(flagged.join(runs, "row", "left_anti"))).unionByName(some)


def digest(collapsed: DataFrame) -> DataFrame:
    """One row per document with its strongest run and hashes of all runs and of what is left.

    The strongest run has the greatest length over period, compared exactly;
    ties go to the smaller start, then the smaller period.
    """
    stronger = lambda a, b: F.when(
        a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), stronger)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    return collapsed.select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
