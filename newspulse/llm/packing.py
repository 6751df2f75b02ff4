"""Packing of token sequences by patterns of few documents.

Texts become token ids; only those longer than a sequence are cut. Patterns
are the ways to fill a sequence exactly with one to three pieces. How often
each pattern is used is fitted to the histogram of piece lengths by
non-negative least squares, long pieces weighing more, as short ones are easy
to place later. The counts are rounded, and the pieces that are left are
packed best fit first, from the longest length down, many equal sequences at
a time. All of this sees the histogram only, whose size is that of a sequence;
pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.llm.common import slices, utf8
from newspulse.session import settle

CAPACITY = 2048
STEPS = 300  # of the fit
SHORT, KEPT_BACK = 5, 0.1  # this share of the pieces below capacity / SHORT is left for filling gaps after rounding
KNOWN_WORDS = 600_000  # words whose ids a task remembers
RANK_BUCKET = 10_000  # pieces of a length that are numbered together
Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, pieces in a row), ...) and how many such sequences


class WordIds:
    """Ids of texts, word by word: the tokenizer never joins what white space separates.

    A word of Latin or Cyrillic letters is encoded together with others, as each of its last
    ids ends a word; ASCII punctuation behind it is a token run of its own.
    Letters A-Z are lower-cased by the tokenizer, so words may come that way.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        try:
            from tokenizers import Tokenizer
        except ImportError as missing:
            raise ImportError("packing needs the package tokenizers on every executor") from missing
        tokenizer = Tokenizer.from_str(vocabulary)
        self.encode = tokenizer.encode_batch_fast
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()

    def learn(self, words: set[bytes]) -> None:
        """Make lower-cased words known; when there are too many, those that came in one call only are forgotten."""
        if len(self.known) > KNOWN_WORDS:
            if len(self.again) > KNOWN_WORDS // 2:
                self.again.clear()
            self.again.update(w for w in words if w in self.known)
            self.known = {w: self.known[w] for w in self.again}
        new = words.difference(self.known)
        self.again.update(words - new)
        tails = {w: m.end(1) for w in new if not w.isalpha() and (m := _TAIL.fullmatch(w))}
        parts = {w[:k] for w, k in tails.items()} | {w[k:] for w, k in tails.items()}
        self._encode((new.difference(tails) | parts).difference(self.known))
        self.known.update((w, self.known[w[:k]] + self.known[w[k:]]) for w, k in tails.items())

    def _encode(self, words: set[bytes]) -> None:
        letters = [w for w in words if w.isalpha() or _LETTERS.fullmatch(w)]
        joined = [letters[k : k + 200] for k in range(0, len(letters), 200)]
        for part, e in zip(joined, self.encode([b" ".join(p).decode() for p in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            self.known.update(zip(part, (raw[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))
        others = list(words.difference(letters))
        for k in range(0, len(others), 10_000):
            part = others[k : k + 10_000]
            found = self.encode([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found, strict=True))

    def ids(self, words: list[bytes], end: bytes) -> bytes:
        return b"".join(map(self.known.__getitem__, words)) + end


#: UTF-8 of a-z, U+00C0 to U+023F and U+0400 to U+047F without the two signs among them and the capital I with
#: a dot: each is one letter, composed or not, also in lower case.
_MORE = rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8\xd0\xd1][\x80-\xbf])"
_LETTER = rb"(?=[a-z\xc3-\xd1])[a-z]*(?:" + _MORE + rb"[a-z]*)*"
_LETTERS = re.compile(_LETTER)
#: Letters, then ASCII punctuation.
_TAIL = re.compile(rb"(" + _LETTER + rb")[!-/:-@\[-`{-~]+")


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """A worker keeps the words of its earlier tasks."""
    return WordIds(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every row of (doc_id, text).

    ``vocabulary`` is the content of a tokenizer file whose tokens don't span
    white space; ``end`` follows each text's ids, so a null or empty text is
    one piece of length 1. ``row`` tells repeated rows from each other.
    """
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    columns = [c.split()[0] for c in schema.split(", ")]
    last = np.array([end], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(vocabulary)
        for frame in slices(frames, "text", 2_000_000):
            texts = [utf8(t).lower().split() for t in frame["text"]]
            known.learn({w for words in texts for w in words})
            out = []
            for row, doc_id, words in zip(frame["row"], frame["doc_id"], texts, strict=True):
                raw = known.ids(words, last)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids = (np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()
                    out.append((row, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *ids))
            done = pd.DataFrame(out, columns=columns)
            done["doc_id"] = done["doc_id"].astype("Int64")
            yield done

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(run, schema)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0 for none), ascending, that fill a sequence exactly."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = False
    out = [np.array([[0, 0, capacity]])[: int(have[capacity])]]
    a = np.flatnonzero(have)
    two = a[(a <= capacity // 2) & have[capacity - a]]
    out.append(np.stack([np.zeros_like(two), two, capacity - two], axis=1))
    for x in a[a <= capacity // 3]:
        y = a[(a >= x) & (a <= (capacity - x) // 2)]
        y = y[have[capacity - x - y]]
        out.append(np.stack([np.full_like(y, x), y, capacity - x - y], axis=1))
    return np.concatenate(out)


def fit(hist: np.ndarray, ways: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each of ``ways``, so that pieces used are close to ``hist``.

    Non-negative least squares by accelerated projected gradients, each length
    weighing as much as it has tokens.
    """
    n = len(hist)
    scale = float(hist.max(initial=1))
    weight = (np.arange(n) / (n - 1)) ** 2
    target = hist / scale
    flat = ways.ravel()
    real = (flat > 0).astype(np.float64)
    used = lambda x: np.bincount(flat, np.repeat(x, 3) * real, n)
    back = lambda r: (weight * r)[ways].sum(axis=1)  # noqa: E731  weight[0] is 0
    v = np.ones(len(ways))
    for _ in range(12):  # the largest eigenvalue
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(steps):
        following = np.maximum(y - rate * back(used(y) - target), 0)
        if ((y - following) * (following - x)).sum() > 0:
            t = 1.0  # the momentum points uphill: start it anew
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = following + (t - 1) / after * (following - x)
        x, t = following, after
    return x * scale


def rounded(x: np.ndarray, ways: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, what is left of hist): whole numbers near ``x`` that ``hist`` can serve.

    Running sums are rounded, so neighbouring patterns share what each alone
    would lose. Patterns with the longest pieces come first.
    """
    order = np.lexsort((ways[:, 0], ways[:, 1], -ways[:, 2]))
    sums = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
    whole = np.diff(sums, prepend=0)
    left = hist.astype(np.int64).tolist()
    counts = np.zeros(len(ways), np.int64)
    for k in np.flatnonzero(whole):
        lengths = [n for n in ways[order[k]].tolist() if n]
        n = min([int(whole[k]), *(left[m] // lengths.count(m) for m in lengths)])
        for m in lengths:
            left[m] -= n
        counts[order[k]] = n
    return counts, np.array(left)


def best_fit(hist: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing over a histogram; equal sequences are filled together."""
    done: list[Group] = []
    room: dict[int, list[Group]] = {}
    levels: list[int] = []
    lengths = np.flatnonzero(hist)
    least = int(lengths[0]) if len(lengths) else 0

    def put(space: int, group: Group) -> None:
        if space < least:
            done.append(group)
            return
        if space not in room:
            room[space] = []
            insort(levels, space)
        room[space].append(group)

    for n in lengths[::-1].tolist():
        c = int(hist[n])
        while c:
            k = bisect_left(levels, n)
            if k == len(levels):
                break
            space = levels[k]
            parts, m = room[space].pop()
            if not room[space]:
                del room[space], levels[k]
            t = space // n
            full = min(m, c // t)
            if full:
                put(space - t * n, ((*parts, (n, t)), full))
            c, m = c - full * t, m - full
            if m and c:
                part = min(c, t)
                put(space - part * n, ((*parts, (n, part)), 1))
                c, m = c - part, m - 1
            if m:
                put(space, (parts, m))
        if c:
            t = capacity // n
            if c // t:
                put(capacity - t * n, (((n, t),), c // t))
            if c % t:
                put(capacity - c % t * n, (((n, c % t),), 1))
    return done + [g for groups in room.values() for g in groups]


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Sequences for a histogram of piece lengths (index: length), as groups of equal ones."""
    ways = patterns(np.flatnonzero(hist), capacity)
    groups: list[Group] = []
    left = hist.astype(np.int64)
    if len(ways):
        aim = left.astype(np.float64)
        aim[: capacity // SHORT] *= 1 - KEPT_BACK
        counts, left = rounded(fit(aim, ways), ways, left)
        for k in np.flatnonzero(counts):
            parts = tuple((n, 1) for n in ways[k][::-1].tolist() if n)
            groups.append((parts, int(counts[k])))
    return groups + best_fit(left, capacity)


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """Places in order of length: first place, sequence, pieces in a row, offset and length of each stretch."""
    rows, sequence = [], 0
    for parts, m in groups:
        offset = 0
        for n, t in parts:
            rows.append((n, sequence, t, offset, m * t))
            offset += n * t
        sequence += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    first = np.cumsum(table[:, 4]) - table[:, 4]
    return {"first": first, "length": table[:, 0], "sequence": table[:, 1], "row": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of (doc_id, text).

    The driver sees one count per length; the places it hands out are one row
    per length and group of equal sequences, so at most a few for each way to
    fill a sequence, whatever the number of documents. Null text counts as
    empty, null and repeated ids are documents like others, an empty table
    gives none. Other columns are not looked at.
    """
    cut = settle(pieces(docs, vocabulary, capacity, end, with_ids), "pieces")
    count = settle(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    hist = np.zeros(capacity + 1, np.int64)
    for r in count.collect():
        hist[r.length] = r.n
    places = slots(plan(hist, capacity))
    before = np.cumsum(hist) - hist
    key = F.xxhash64("row", "piece")
    # At most ``capacity`` lengths, so this side is always small.
    dealt = cut.join(F.broadcast(count), "length").withColumn("bucket", F.pmod(key, F.ceil(F.col("n") / RANK_BUCKET))).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    sizes = settle(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "rank-buckets")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("rank", within).join(sizes.select("length", "bucket", start.alias("ahead")), ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("ahead") + F.col("rank") - 1).alias("rank"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = before[frame["length"].to_numpy()] + frame["rank"].to_numpy()
            k = np.searchsorted(places["first"], at, side="right") - 1
            inside = at - places["first"][k]
            row = places["row"][k]
            frame = frame.drop(columns="rank")
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["sequence_id"] = places["sequence"][k] + inside // row
            frame["offset"] = places["offset"][k] + inside % row * places["length"][k]
            yield frame

    return ranked.mapInPandas(place, fields)
