"""Removal of long byte strings that occur more than once in the corpus.

Strings of LENGTH bytes are brought together by an anchor: the place in the
string where the hash of SEED bytes is smallest. Equal strings have equal
anchors, so all strings that could be equal share an anchor's hash, and the
strings that share one in a text form a region of it. Only regions whose hash
occurs again are read; equal regions become one with a weight; and the regions
of a hash are searched together by interval expansion on a Burrows-Wheeler
transform. Hashes with very many regions are split by the bytes that all
strings of a narrower region have in common, at last by the string itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.llm.bwt import repeated_starts
from newspulse.llm.common import slices, utf8
from newspulse.llm.hashing import Rolling
from newspulse.session import settle

LENGTH, SEED = 400, 64
BATCH = 1 << 20  # bytes of regions in one transform
LARGE = 4 << 20  # bytes of one hash's regions beyond which they are split
NARROW = 32  # string starts of a region after the first split


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` consecutive values, from running minima of blocks."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(hash, region hash, first start, last start, anchor) of the regions of a text.

    The starts of all strings of ``length`` bytes are dealt to the anchors of
    their strings, the last one where the smallest hash occurs twice.
    """
    w = length - seed + 1
    roll = Rolling(data)
    h = roll.windows(seed)
    low = _window_min(h, w)
    # A place is the smallest of some window if it equals the largest minimum of all windows it is in.
    ends = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h == ~_window_min(~np.concatenate([ends, low, ends]), w))
    # The anchor can change where the minimum does and where another such place enters the window.
    starts = np.unique(np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, np.maximum(at - w + 1, 0)]))
    # The last place of a value up to a window's end, by (value, place).
    values, span = np.unique(h[at]), len(h) + 1
    known = np.sort(np.searchsorted(values, h[at]) * span + at)
    ask = np.searchsorted(values, low[starts]) * span + starts + w - 1
    anchor = known[np.searchsorted(known, ask, side="right") - 1] % span
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, anchor = starts[change], anchor[change]
    last = np.concatenate([first[1:], [len(low)]]) - 1
    return h[anchor], roll.of(first, last + length), first, last, anchor


def _describe(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, digest, n_bytes, sha, segs) of every row; segs are a text's regions."""
    parts = "f long, r long, lo int, n int, off int"
    schema = "doc_id long, digest binary, n_bytes long, sha string, " + ", ".join(
        "{} array<{}>".format(*p.split()) for p in parts.split(", "))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, np.int32)] * 3)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 2_000_000):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                raw = utf8(text)
                sha = hashlib.sha256(raw)
                segs = none
                if len(raw) >= length:
                    f, r, lo, hi, at = segments(np.frombuffer(raw, np.uint8), length, seed)
                    segs = (f.view(np.int64), r.view(np.int64), *(x.astype(np.int32) for x in (lo, hi - lo + length, at - lo)))
                rows.append((doc_id, sha.digest()[:16], len(raw), sha.hexdigest(), *segs))
            out = pd.DataFrame(rows, columns=["doc_id", "digest", "n_bytes", "sha", "f", "r", "lo", "n", "off"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema).select(
        "doc_id", "digest", "n_bytes", "sha", F.arrays_zip("f", "r", "lo", "n", "off").alias("segs"))


def _expand(regions: DataFrame, length: int) -> DataFrame:
    """(f, r, lo, hi): runs of repeated string starts of each region (f, r, weight, bytes).

    Regions of a hash are neighbours after the sort; whole hashes fill a
    batch. A region that comes twice (of a repeated row) counts once.
    """

    def search(part: list[tuple]) -> pd.DataFrame:
        found = repeated_starts([p[3] for p in part], np.array([p[2] for p in part]), length)
        rows = []
        for (f, r, _, _), at in zip(part, found, strict=True):
            cuts = np.flatnonzero(np.diff(at) != 1) + 1
            for run in np.split(at, cuts) if len(at) else ():
                rows.append((f, r, int(run[0]), int(run[-1])))
        return pd.DataFrame(rows, columns=["f", "r", "lo", "hi"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[tuple] = []
        size, last = 0, None
        for frame in frames:
            for row in zip(frame["f"], frame["r"], frame["weight"], frame["bytes"], strict=True):
                if row[:2] == last:
                    continue
                if size >= BATCH and last is not None and row[0] != last[0]:
                    yield search(part)
                    part, size = [], 0
                part.append(row)
                size, last = size + len(row[3]) + 1, row[:2]
        if part:
            yield search(part)

    return regions.select("f", "r", "weight", "bytes").repartition("f").sortWithinPartitions("f", "r").mapInPandas(
        run, "f long, r long, lo int, hi int")


def _split(regions: DataFrame, length: int, width: int) -> DataFrame:
    """Regions cut into narrower ones of up to ``width`` starts, keyed by their common bytes.

    Columns: f, r (of the narrower region), off, weight, bytes, and pf, pr,
    base to come back. Cuts are aligned to the anchor, so that equal strings
    fall into the same cut.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "bytes", 100_000):
            rows = []
            for f, r, off, weight, raw in zip(frame["f"], frame["r"], frame["off"], frame["weight"], frame["bytes"], strict=True):
                roll, count = Rolling(np.frombuffer(raw, np.uint8)), len(raw) - length + 1
                starts = np.arange(count)
                block = (off - starts) // width
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                last = np.concatenate([first[1:], [count]]) - 1
                # The bytes that all strings of a block have in common; a block cut short has them too.
                top = off - block[first] * width  # the largest start a block can have
                core = roll.of(top, top - width + 1 + length)
                whole = roll.of(first, last + length)
                for a, b, k, c, w in zip(first.tolist(), last.tolist(), block[first].tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True):
                    rows.append((hash((f, k, c)), w, off - a, weight, raw[a : b + length] if width > 1 else b"", f, r, a))
            yield pd.DataFrame(rows, columns=["f", "r", "off", "weight", "bytes", "pf", "pr", "base"])

    return regions.select("f", "r", "off", "weight", "bytes").mapInPandas(
        run, "f long, r long, off int, weight long, bytes binary, pf long, pr long, base int")


def _repeated(regions: DataFrame, length: int, large: int, widths: tuple[int, ...]) -> DataFrame:
    """(f, r, lo, hi) for regions (f, r, off, weight, bytes), whatever the size of a hash's group."""
    size = regions.groupBy("f").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > large).select("f")
    size = settle(size, "large-groups")
    if not widths or size.isEmpty():
        return _expand(regions, length)
    done = _expand(regions.join(size, "f", "left_anti"), length)
    parts = settle(_split(regions.join(size, "f", "left_semi"), length, widths[0]), "split-regions")
    merged = parts.groupBy("f", "r").agg(F.min("off").alias("off"), F.sum("weight").alias("weight"), F.first("bytes").alias("bytes"))
    if widths[0] == 1:
        found = merged.where("weight > 1").select("f", "r", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    else:
        twice = merged.groupBy("f").agg(F.sum("weight").alias("w")).where("w > 1").select("f")
        found = _repeated(settle(merged.join(twice, "f", "left_semi"), "narrow-regions"), length, large, widths[1:])
    back = parts.select("f", "r", "pf", "pr", "base").join(found, ["f", "r"]).select(
        F.col("pf").alias("f"), F.col("pr").alias("r"), (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    return done.unionByName(back)


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): every row with the digest of its text, and per digest the
    byte ranges covered by strings of ``length`` bytes that occur elsewhere."""
    base = settle(_describe(docs, length, seed), "text-segments")
    rows = base.select("doc_id", "digest", "n_bytes", "sha")
    one = base.groupBy("digest").agg(
        F.first("segs").alias("segs"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    places = one.where(F.size("segs") > 0).select("digest", "rep", "copies", F.explode("segs").alias("s")).select(
        "digest", "rep", "copies", "s.f", "s.r", "s.lo", "s.n", "s.off")
    again = places.groupBy("f").agg(F.sum("copies").alias("k")).where("k > 1").select("f")
    places = settle(places.join(again, "f"), "repeated-anchors")
    chosen = places.groupBy("f", "r").agg(
        F.sum("copies").alias("weight"), F.min(F.struct("digest", "lo", "n", "off", "rep")).alias("p"))
    wanted = chosen.groupBy(F.col("p.digest").alias("digest"), F.col("p.rep").alias("rep")).agg(
        F.collect_list(F.struct("f", "r", "weight", "p.lo", "p.n", "p.off")).alias("wanted"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 1_000_000):
            rows = []
            for digest, text, some in zip(frame["digest"], frame["text"], frame["wanted"], strict=True):
                raw = utf8(text)
                if hashlib.sha256(raw).digest()[:16] == digest:  # a repeated id may have other texts
                    rows += [(s["f"], s["r"], s["off"], s["weight"], raw[s["lo"] : s["lo"] + s["n"]]) for s in some]
            yield pd.DataFrame(rows, columns=["f", "r", "off", "weight", "bytes"])

    named = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("digest", "text", "wanted")
    regions = settle(named.mapInPandas(cut, "f long, r long, off int, weight long, bytes binary"), "regions")
    found = settle(_repeated(regions, length, large, (NARROW, 1)), "repeated-runs")
    per_text = places.select("digest", "f", "r", F.col("lo").alias("at")).join(found, ["f", "r"]).groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct((F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + length).alias("b")))).alias("spans"))
    return rows, per_text


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED, large: int = LARGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, spans) for every row.

    ``text`` is what is left (bytes), null where nothing was removed; spans
    are the maximal removed runs. Null counts as an empty text; texts under
    ``length`` bytes lose nothing; of equal long texts all bytes go. Repeated
    rows each give a row, an empty table none. Other columns are not looked at.
    """
    rows, found = spans(docs, length, seed, large)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, spans array<struct<a:int,b:int>>"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 4_000_000):
            out = []
            for doc_id, text, some in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
                raw, runs = utf8(text), []
                for s in some:
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["b"])
                    else:
                        runs.append([s["a"], s["b"]])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left, [{"a": a, "b": b} for a, b in runs]))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    hit = settle(found, "spans-by-text")
    texts = docs.select("doc_id", "text", F.unhex(F.substring(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), 1, 32)).alias("digest"))
    touched = texts.join(hit, "digest").select("doc_id", "text", "spans").mapInPandas(cut, schema)
    whole = rows.join(hit.select("digest"), "digest", "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("text"),
        F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    return touched.unionByName(whole)
