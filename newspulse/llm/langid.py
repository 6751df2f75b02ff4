"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three
characters, words padded by blanks) in order of frequency. A document's own
list is compared with each profile by the out-of-place distance: the sum of
the differences in rank, or the profile's length for an n-gram it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.llm.common import held_out, slices

TOP = 300  # n-grams of a profile and of a document
UNDETERMINED = "und"
_BLANK = np.uint64(0x20)


@lru_cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter; every other code point becomes a blank."""
    out = np.full(0x110000, 0x20, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) if len(low) else c
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a text's n-grams; a key packs up to three code points."""
    codes = _letters()[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "replace"), dtype=np.uint32)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20)  # runs of blanks become one
    c = codes[keep].astype(np.uint64)
    if len(c) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    # A blank stands for a word's edge only: not alone, nor in the middle.
    grams = np.concatenate([c[c != _BLANK], two, three[c[1:-1] != _BLANK]])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def has_letter(keys: np.ndarray) -> bool:
    return bool(len(keys)) and bool((keys != _BLANK).any())


def top(keys: np.ndarray, counts: np.ndarray, k: int = TOP) -> np.ndarray:
    """The keys of the ``k`` largest counts; ties go to the smaller key."""
    return keys[np.lexsort((keys, -counts))[:k]]


def fit_profiles(docs: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, rank, gram) from all rows of (text, lang) with a language.

    Each task adds up its own counts, so a language with most of the rows
    sends no more than its distinct n-grams per task.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, pd.Series] = {}
        waiting: dict[str, list] = {}

        def settle_counts(lang: str) -> None:
            parts = waiting.pop(lang, [])
            if parts:
                keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                s = pd.Series(counts, index=keys).groupby(level=0).sum()
                totals[lang] = totals[lang].add(s, fill_value=0) if lang in totals else s

        for frame in slices(frames, "text", 4_000_000):
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                waiting.setdefault(lang, []).append(gram_counts(text))
            for lang in list(waiting):
                settle_counts(lang)
        for lang, s in totals.items():
            yield pd.DataFrame({"lang": lang, "gram": s.index.to_numpy().astype(np.int64), "n": s.to_numpy().astype(np.int64)})

    counts = docs.select("text", "lang").where(F.col("lang").isNotNull()).mapInPandas(count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language's grams stay spread: each task of the rank limit keeps k of them.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


class Profiles:
    """Rank of every profile n-gram in every language, as one table."""

    def __init__(self, rows: list[tuple[str, int, int]], k: int):
        self.k = k
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.keys = np.unique(np.array([r[2] for r in rows], dtype=np.uint64))
        # The last row is that of an n-gram in no profile; -1 stands for absent.
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.keys, np.uint64(gram)), at[lang]] = rank

    def distances(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == grams, at, len(self.keys)) if len(self.keys) else at
        ranks = self.ranks[at]
        moved = np.abs(ranks - np.arange(len(grams), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.k, np.minimum(moved, self.k)).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text)
        if not has_letter(keys) or not self.langs:
            return UNDETERMINED, 0.0
        grams = top(keys, counts, self.k)
        d = self.distances(grams)
        best = int(np.argmin(d))
        return self.langs[best], float(1 - d[best] / (self.k * len(grams)))


def identify(docs: DataFrame, profiles: DataFrame, k: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text).

    ``profiles`` holds ``k`` rows per language; it goes to the tasks whole,
    bounded by the number of languages times ``k``. ``score`` is one minus the
    share of the largest possible distance. ``und`` and 0 for a null text, one
    without a letter, or when nothing was learned; ties go to the language
    first in order. Repeated rows each give a row, empty tables none. Other
    columns are not looked at.
    """
    model = Profiles([tuple(r) for r in profiles.select("lang", "rank", "gram").collect()], k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 8_000_000):
            found = [model.predict(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"],
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "text", "held_out").mapInPandas(run, schema)


def learn_and_identify(docs: DataFrame, modulus: int = 3, rest: int = 1, k: int = TOP) -> DataFrame:
    """Profiles from the rows not held out; a prediction for every row."""
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", modulus, rest).alias("held_out"))
    return identify(rows, fit_profiles(rows.where(~F.col("held_out")), k), k)
