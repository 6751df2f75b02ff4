"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document
frequencies counted over the whole corpus. A randomised singular value
decomposition, whose products run as Spark jobs over the passages, gives a
latent space, whose rank is raised until it keeps the passages. Every window of
every document is folded into that space and compared with all passages. Only
items of which the space keeps too little, and those shorter than a window, are
sought by their rarest words instead, of which no leak can hold fewer than some.
What either way finds is checked by the longest common subsequence of words, and
a paraphrase also by its answer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.llm.common import slices, utf8
from newspulse.session import settle

FEATURES = 1 << 17  # hashed words
BLOCK = 16  # windows start every so many words ...
SCALES = (2, 3, 4)  # ... and span so many blocks
LEAST_RANK, RANK, OVERSAMPLE, POWER = 64, 256, 10, 2  # the rank doubles from the first to the second
KEPT = 0.7  # length of its image from which a passage is left to the latent space
COSINE = 0.3  # of a window with a passage, by their images
BARE = 0.5  # a window counts as at least so much of a passage's length
SAME, PARAPHRASE = 0.8, 0.55  # share of an item's words found in order
ANSWER_WORDS = 5  # the end of an item is its answer where it has no other
MIN_WORDS = 6  # items of fewer words have to stand in the text as they are
SMALL, GATE_STEPS = 64, 16  # items up to SMALL words are sought together; so many of their sizes of text at a time
RARE_HITS = 4  # words that a leak must have of an item's rarest ones
ITEMS_AT_ONCE = 20_000  # passages searched in one pass over the documents
ENTRIES_AT_ONCE = 2_000_000  # rare words of some texts, with the items that have them, that are counted together


#: Letters and digits, A-Z lower-cased, bytes of other scripts as they are; all else is a gap.
_WORD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased."""
    return utf8(text).translate(_WORD).split()


def features_of(words, size: int | None = None) -> np.ndarray:
    """The feature of every word; ``size`` is their number where they have no length."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words) if size is None else size) % FEATURES


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that hold each feature, over all rows; the last entry counts the rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FEATURES + 1, dtype=np.int64)
        for frame in slices(frames, "text", 4_000_000):
            for text in frame["text"]:
                seen[features_of(set(words_of(text)))] += 1  # one assignment, so a feature of two words counts once
                seen[FEATURES] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": at, "n": seen[at]})

    out = np.zeros(FEATURES + 1, dtype=np.int64)
    totals = docs.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for r in totals.collect():  # at most FEATURES + 1 rows
        out[r.feature] = r.n
    return out


def idf_of(seen: np.ndarray) -> np.ndarray:
    return np.log((seen[-1] + 1) / (seen[:-1] + 1)).astype(np.float32) + np.float32(0.1)


def passages(items: DataFrame) -> DataFrame:
    """(item_id, part, words) of items with words."""
    size = BLOCK * SCALES[-1]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                w = words_of(text)
                if w:
                    parts = max(1, round(len(w) / size))
                    cuts = [len(w) * i // parts for i in range(parts + 1)]
                    rows += [(item, i, [x.decode("utf-8", "replace") for x in w[a:b]]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["item_id", "part", "words"])

    return items.select("item_id", "text").mapInPandas(cut, "item_id long, part int, words array<string>")


def weigh(words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's features and their TF-IDF weights, of length one."""
    f, n = np.unique([zlib.crc32(w.encode()) % FEATURES for w in words], return_counts=True)
    v = n * idf[f]
    return f, (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def latent_space(cut: DataFrame, idf: np.ndarray, features: np.ndarray, rank: int = RANK, seed: int = 0) -> np.ndarray:
    """Leading right singular vectors (features x rank) of the passages' matrix.

    Each product of A'A with a thin matrix is one job: a task multiplies its
    own passages and returns blocks of rows, which are summed by block. The
    thin matrix has at most FEATURES rows, whatever the number of passages.
    """
    sc, width = cut.sparkSession.sparkContext, min(rank + OVERSAMPLE, len(features))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(features), width)))[0].astype(np.float32)
    rows_per_block = 2048

    def gram(q: np.ndarray) -> np.ndarray:
        held = sc.broadcast((q, features, idf))

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, features, idf = held.value
            out = np.zeros_like(q)
            for frame in frames:
                for w in frame["words"]:
                    f, v = weigh(list(w), idf)
                    at = np.searchsorted(features, f)
                    out[at] += v[:, None] * (v @ q[at])
            for b in range(0, len(out), rows_per_block):
                block = out[b : b + rows_per_block]
                if block.any():
                    yield pd.DataFrame({"block": [b // rows_per_block], "v": [block.astype(np.float32).tobytes()]})

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            v = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["v"])
            return pd.DataFrame({"block": frame["block"].iloc[:1], "v": [v.astype(np.float32).tobytes()]})

        out = np.zeros_like(q)
        sums = cut.mapInPandas(part, "block int, v binary").groupBy("block").applyInPandas(total, "block int, v binary")
        for r in sums.collect():  # at most FEATURES / rows_per_block rows
            at = r.block * rows_per_block
            block = np.frombuffer(r.v, np.float32).reshape(-1, q.shape[1])
            out[at : at + len(block)] = block
        return out

    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    return np.ascontiguousarray((q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32))


def kept_by(cut: DataFrame, idf: np.ndarray, features: np.ndarray, space: np.ndarray, share: float) -> int:
    """How many passages have an image of less than ``share`` of their length."""
    held = cut.sparkSession.sparkContext.broadcast((space, features, idf))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, features, idf = held.value
        for frame in frames:
            images = [v @ space[np.searchsorted(features, f)] for f, v in (weigh(list(w), idf) for w in frame["words"])]
            yield pd.DataFrame({"n": [sum(float(np.linalg.norm(x)) < share for x in images)]})

    return cut.mapInPandas(part, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def raised_space(cut: DataFrame, idf: np.ndarray, features: np.ndarray, most: int = RANK) -> np.ndarray:
    """The latent space of the least rank, doubled up to ``most``, that keeps every passage.

    It ends at ``most``, which bounds what a task holds, with passages kept or not.
    """
    most = min(most, cut.count())  # more have no image of any passage
    rank = min(LEAST_RANK, most)
    while True:
        space = latent_space(cut, idf, features, rank)
        if rank == most or not kept_by(cut, idf, features, space, KEPT):
            return space
        rank = min(2 * rank, most)


class Item:
    """An item's words as bit masks for the subsequence check."""

    def __init__(self, words: list[bytes], answer: list[bytes]):
        self.size, self.answer = len(words), answer
        self.same = SAME if self.size >= MIN_WORDS else 2.0  # no share is enough for a short item
        self.masks: dict[bytes, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.counts = {w: mask.bit_count() for w, mask in self.masks.items()}
        self.words = frozenset(self.masks)

    def common(self, region: list[bytes], least: float = 0) -> int:
        """Length of the longest common subsequence with ``region``; 0 if surely below ``least``."""
        if least:
            shared = self.words.intersection(region)
            if self.size - len(self.words) + len(shared) < least or sum(map(self.counts.__getitem__, shared)) < least:
                return 0
        held = [m for m in map(self.masks.get, region) if m]
        full = row = (1 << self.size) - 1
        for m in held:
            u = row & m
            row = ((row + u) | (row - u)) & full
        return self.size - row.bit_count()

    def answered(self, region: list[bytes]) -> bool:
        n, a = len(self.answer), self.answer
        return bool(n) and any(region[i : i + n] == a for i, w in enumerate(region) if w == a[0])


def least_of(share: float, size: int) -> int:
    """The least number of words that is ``share`` of ``size``, as the check divides them."""
    n = math.floor(share * size)
    return n if n / size >= share else n + 1


class Gate(NamedTuple):
    """Items of at most ``size`` words by their features: which of them can stand in a piece of text."""

    size: int
    step: int  # windows that start in so many words are looked at together
    starts: np.ndarray  # by row of the latent space: where its entries begin
    items: np.ndarray
    counts: np.ndarray  # how often the feature stands in the item; only the rarest features have entries
    first: np.ndarray  # by item: words of these entries that a leak has at least
    least: np.ndarray  # (items, 3): words that a leak has in common at least; those with an answer; features of the answer
    which: np.ndarray
    rows: list[np.ndarray]  # by item: its features, sorted, and their counts
    own: list[np.ndarray]


def gates_of(checks: list[tuple], place: np.ndarray, rows: int, idf: np.ndarray) -> list[Gate]:
    """Gates of the items (k, Item), one for each power of two of their sizes from SMALL.

    A leak has ``least`` of an item's n words, so it has RARE_HITS of any
    n - least + RARE_HITS of them; the rarest are looked up.
    """
    by_size: dict[int, list[int]] = {}
    for k, (_, item) in enumerate(checks):
        by_size.setdefault(max(SMALL, 1 << (item.size - 1).bit_length()), []).append(k)
    out = []
    for size, which in sorted(by_size.items()):
        least, held, own, entries, first = [], [], [], [], []
        for j, k in enumerate(which):
            item, total, weight = checks[k][1], {}, {}
            for w, mask in item.masks.items():
                feature = zlib.crc32(w) % FEATURES
                entry = total.setdefault(int(place[feature]), [0, 0])
                entry[0] += mask.bit_count()
                entry[1] |= w in item.answer
                weight[int(place[feature])] = idf[feature]
            held.append(np.array(sorted(total)))
            own.append(np.array([total[x] for x in sorted(total)]))
            least.append((least_of(item.same, item.size), least_of(PARAPHRASE, item.size), own[-1][:, 1].sum()))
            least_words = item.size if item.size < MIN_WORDS else min(least[-1][:2])
            hits, taken = min(RARE_HITS, least_words), 0
            for row in sorted(total, key=lambda x: (-weight[x], x)):
                if taken >= item.size - least_words + hits:
                    break
                entries.append((row, j, total[row][0]))
                taken += total[row][0]
            first.append(hits)
        at, items, counts = np.array(sorted(entries)).T
        out.append(Gate(
            size, GATE_STEPS * size, np.searchsorted(at, np.arange(rows + 1)), items, counts, np.array(first),
            np.array(least), np.array(which), held, own))
    return out


def _possible(shared: np.ndarray, answer: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether so many common words, and so many of the answer, can make a leak."""
    same, paraphrase, whole = least.T
    return (shared >= same) | ((shared >= paraphrase) & (answer >= whole))


def _texts_of(gate: Gate, at: np.ndarray, first: np.ndarray) -> list[int]:
    """Of texts whose words' rows are in ``at`` from ``first`` on, those with enough rare words of an item of the gate."""
    filled = np.append(np.diff(gate.starts) > 0, False)  # the last one is that of words of no item
    hits = np.flatnonzero(filled[at])
    text, row = divmod(np.unique((np.searchsorted(first, hits, side="right") - 1) * len(filled) + at[hits]), len(filled))
    begin = gate.starts[row]
    n = gate.starts[row + 1] - begin
    ends = np.cumsum(n)
    if not len(ends) or ends[-1] > ENTRIES_AT_ONCE:
        return np.unique(text).tolist()
    entries = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
    pair, which = np.unique(np.repeat(text, n) * len(gate.first) + gate.items[entries], return_inverse=True)
    text, item = divmod(pair, len(gate.first))
    return np.unique(text[np.bincount(which, gate.counts[entries]) >= gate.first[item]]).tolist()


def _by_words(at: np.ndarray, gate: Gate, checks: list[tuple]) -> Iterator[tuple[int, int]]:
    """(first word, item) of every longest window around which enough words of an item of the gate stand.

    ``at`` has the rows of a document's words, -1 for words of no item. Words
    are counted in any order, so nothing is lost that the check would find.
    """
    span = BLOCK * SCALES[-1]
    filled = np.append(np.diff(gate.starts) > 0, False)  # the last one is that of words of no item
    hits = np.flatnonzero(filled[at])
    for a in range(0, len(at), gate.step) if len(hits) else ():
        low, high = max(0, a - gate.size), a + gate.step + span + gate.size
        seen = at[hits[np.searchsorted(hits, low) : np.searchsorted(hits, high)]]
        if not len(seen):
            continue
        seen, piece = np.unique(seen), at[low:high]
        first = gate.starts[seen]
        n = gate.starts[seen + 1] - first
        ends = np.cumsum(n)
        entries = np.repeat(first - ends + n, n) + np.arange(ends[-1])
        rare = np.bincount(gate.items[entries], gate.counts[entries], len(gate.least))
        starts = np.arange(a, min(a + gate.step, len(at)), BLOCK)
        maybe = np.flatnonzero(rare >= gate.first).tolist()
        if maybe:
            here = np.zeros(len(filled), dtype=bool)
            here[piece] = True
        for i in maybe:
            rows, size = gate.rows[i], checks[gate.which[i]][1].size
            if not _possible(*(here[rows] @ gate.own[i])[:, None], gate.least[i : i + 1])[0]:
                continue
            row = np.minimum(np.searchsorted(rows, piece), len(rows) - 1)
            held = np.flatnonzero(rows[row] == piece)
            row, before = row[held], np.full(len(held), -1)
            order = np.argsort(row, kind="stable")
            again = np.flatnonzero(row[order[1:]] == row[order[:-1]])
            before[order[again + 1]] = held[order[again]] + low
            held += low
            # A word counts in a window where it first stands in it.
            begin = np.maximum(starts - size, 0)[:, None]
            once = (held >= begin) & (before < begin) & (held < starts[:, None] + span + size)
            shared_here = once.astype(np.float32) @ gate.own[i][row].astype(np.float32)
            for start in starts[_possible(*shared_here.T, gate.least[i])].tolist():
                yield start, int(gate.which[i])


SCHEMA = "item_id long, cosine double, lcs_words long, lcs_share double, answer_found boolean, first_word long"


def leaks(docs: DataFrame, items: DataFrame, rank: int = RANK, cosine: float = COSINE, exact: bool = True) -> DataFrame:
    """One row per (document, benchmark item) where the item is in the text.

    ``items`` has item_id, text and, if known, answer; otherwise an item's
    last words are its answer. An item is found where SAME of its words stand
    in order within a stretch of the text, or PARAPHRASE of them and the
    answer; one of fewer than MIN_WORDS words where it stands as it is.
    ``cosine`` is that of the window that led to it with the nearest passage
    of the item, estimated from their images; null where rare words led to it.
    ``rank`` is the most that the latent space may have; without ``exact`` it
    is the only way. Null and empty texts and items have no leak, and items
    without id are not sought; each text of an item id that has several gives
    rows of its own. Repeated documents each give their rows; empty tables
    give none. Other columns are not looked at. Items are searched in blocks
    of ITEMS_AT_ONCE, so what a task holds is bounded.
    """
    return _leaks(docs.select("doc_id", "text"), items, rank, cosine, exact)


def _leaks(rows: DataFrame, items: DataFrame, rank: int = RANK, cosine: float = COSINE, exact: bool = True) -> DataFrame:
    """Leaks of (key, text), with the key as first column."""
    spark, idf = rows.sparkSession, idf_of(document_frequencies(rows))
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    items = settle(items.select("item_id", "text", answer.alias("answer")).where(
        F.col("item_id").isNotNull()).dropDuplicates(["item_id", "text"]), "bench-items")
    cut = settle(passages(items), "bench-passages")
    hashed = cut.select(F.explode("words").alias("w")).select(F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(FEATURES)).alias("f")).distinct()
    features = np.sort(np.array([r.f for r in hashed.collect()], dtype=np.int64))  # at most FEATURES
    if not len(features):
        key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"{key} {kind}, {SCHEMA}")
    space = raised_space(cut, idf, features, rank)
    blocks = -(-cut.count() // ITEMS_AT_ONCE)
    found = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        part = _search(rows, mine, idf, features, space, cosine, exact)
        found = part if found is None else found.unionByName(part)
    return found


class Latent(NamedTuple):
    """Items that are sought by the cosine of their passages."""

    space: np.ndarray  # rows of the latent space times idf, by place, then one of zeros for words of no passage
    wanted: np.ndarray | None  # (rank, passages): images over their squared length; none if already in the space
    length: np.ndarray  # of the passages, before they were brought to length one
    owner: np.ndarray  # item of each passage


def routes_of(checks: list[tuple], idf, features, space) -> tuple[Latent, list[int]]:
    """The items (id, Item, words) that the latent space holds, and the places of all others."""
    images, length, owner, rest = [], [], [], []
    for k, (_, item, w) in enumerate(checks):
        parts = max(1, round(len(w) / (BLOCK * SCALES[-1])))
        cuts = [len(w) * i // parts for i in range(parts + 1)]
        own = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            f, v = weigh([x.decode("utf-8", "replace") for x in w[a:z]], idf)
            own.append((v @ space[np.searchsorted(features, f)], float(np.sqrt((idf[features_of(w[a:z])] ** 2).sum()))))
        if item.size < BLOCK or min(np.linalg.norm(image) for image, _ in own) < KEPT:
            rest.append(k)
            continue
        images += [image for image, _ in own]
        length += [x for _, x in own]
        owner += [k] * len(own)
    images = np.array(images, np.float32).reshape(-1, space.shape[1])
    size = np.linalg.norm(images, axis=1)
    wanted = (images / np.maximum(size, 1e-9)[:, None] ** 2).T.copy()
    rows = np.concatenate([space * idf[features][:, None], np.zeros((1, space.shape[1]), np.float32)])
    if len(images) <= space.shape[1]:  # a word's share in the cosine with every passage takes no more room
        rows, wanted = rows @ wanted, None
    return Latent(rows, wanted, np.array(length), np.array(owner, dtype=np.int64)), rest


def _search(docs: DataFrame, items: DataFrame, idf, features, space, cosine: float, exact: bool) -> DataFrame:
    key, kind = docs.columns[0], docs.schema[0].dataType.simpleString()
    checks = []
    for r in items.orderBy("item_id", "text").collect():  # one block of the query set
        w = words_of(r.text)
        if w:
            answer = w if len(w) < MIN_WORDS else words_of(r.answer) or w[-ANSWER_WORDS:]
            checks.append((r.item_id, Item(w, answer), w))
    # Row of the latent space by feature; -1 for a feature of no passage.
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[features] = np.arange(len(features))
    latent, rest = routes_of(checks, idf, features, space)
    gates = gates_of([(k, checks[k][1]) for k in rest], place, len(features), idf) if exact else []
    held = docs.sparkSession.sparkContext.broadcast((latent, place, idf, [c[:2] for c in checks], rest, gates))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 500_000):
            texts = [(at, words) for at, text in zip(frame[key], frame["text"], strict=True) if (words := words_of(text))]
            hits = of_documents([words for _, words in texts], *held.value, cosine) if texts else []
            out = [(texts[i][0], *hit) for i, hit in hits]
            found = pd.DataFrame(out, columns=[key, *(c.split()[0] for c in SCHEMA.split(", "))])
            if kind == "bigint":
                found[key] = found[key].astype("Int64")
            yield found

    return docs.mapInPandas(search, f"{key} {kind}, {SCHEMA}")


def of_documents(texts, latent: Latent, place, idf, checks, rest, gates, cosine: float) -> list[tuple[int, tuple]]:
    """The leaks of some texts with words, as (number of the text, leak), by the order of the items."""
    sizes = np.array([len(words) for words in texts])
    first = np.cumsum(sizes) - sizes
    ids = features_of(chain.from_iterable(texts), int(sizes.sum()))
    at = place[ids]
    best: dict[int, dict[int, tuple]] = {}
    seen = set()
    for text, start, scale, which, near in _by_images(at, idf[ids], sizes, latent, cosine):
        # A window inside one that was checked has nothing more.
        if not any((text, which, start - k) in seen for k in range(SCALES[-1] - scale + 1)):
            if scale == SCALES[-1]:
                seen.add((text, which, start))
            _check(texts[text], start * BLOCK, scale * BLOCK, which, near, checks, best.setdefault(text, {}))
    known = [(None, checks[k][1]) for k in rest]
    for gate in gates:
        for text in _texts_of(gate, at, first):
            for start, which in _by_words(at[first[text] : first[text] + sizes[text]], gate, known):
                _check(texts[text], start, SCALES[-1] * BLOCK, rest[which], None, checks, best.setdefault(text, {}))
    return [(text, hit) for text, own in sorted(best.items()) for _, hit in sorted(own.items())]


def _by_images(at: np.ndarray, weight: np.ndarray, sizes: np.ndarray, latent: Latent, cosine: float) -> Iterator[tuple]:
    """(text, first block, blocks, item, cosine) of every window near a passage, by text, long windows first.

    ``at`` and ``weight`` have the rows and weights of the words of all texts.
    A window has the length of its words that stand in any passage, as others
    are no part of the space, but at least BARE of the passage's length.
    """
    passages = len(latent.owner)
    if not passages or not (at >= 0).any():
        return
    more = SCALES[-1] - 1  # empty blocks after each text, so that windows start in every block and hold one text
    own = -(-sizes // BLOCK)
    lead = np.cumsum(own + more) - own - more
    starts = int(lead[-1] + own[-1])
    cells = np.arange(len(at)) + np.repeat(lead * BLOCK - np.cumsum(sizes) + sizes, sizes)
    grid = np.full((starts + more, BLOCK), -1, np.int32)
    grid.reshape(-1)[cells] = at
    norms = np.bincount(cells // BLOCK, np.where(at >= 0, weight.astype(np.float64) ** 2, 0), starts + more)
    opens = np.arange(starts) - np.repeat(lead, own + more)[:starts] < np.repeat(own, own + more)[:starts]
    shortest = BARE * latent.length.min()
    rows, found = max(256, 120_000 // passages), []
    for a in range(0, starts, rows):
        n = min(rows, starts - a)
        part = np.zeros((n + more, latent.space.shape[1]), np.float32)
        words = np.empty_like(part)
        for place in range(BLOCK):
            part += np.take(latent.space, grid[a : a + n + more, place], axis=0, out=words, mode="wrap")
        if latent.wanted is not None:
            part = part @ latent.wanted
        near, norm, open_ = part, norms[a : a + n + more], opens[a : a + n]
        for scale in range(1, SCALES[-1] + 1):
            if scale > 1:  # added, not differenced, to keep small values exact
                near, norm = near[:-1] + part[scale - 1 :], norm[:-1] + norms[a + scale - 1 : a + n + more]
            if scale in SCALES:
                least = np.where(open_, np.maximum(np.sqrt(norm[:n]), shortest), np.inf)
                i, j = divmod(np.flatnonzero(near[:n] >= (cosine * least).astype(np.float32)[:, None]), passages)
                value = near[i, j] / np.maximum(least[i], BARE * latent.length[j])
                keep = value >= cosine
                found.append((np.full(keep.sum(), scale), i[keep] + a, j[keep], value[keep]))
    scale, block, j, value = map(np.concatenate, zip(*found, strict=True))
    text = np.searchsorted(lead, block, side="right") - 1
    order = np.lexsort((j, block, -scale, text))
    yield from zip(*(x[order].tolist() for x in (text, block - lead[text], scale, latent.owner[j], np.minimum(1.0, value))), strict=True)


def _check(words, start, span, which, near, checks, best) -> None:
    item_id, item = checks[which]
    if which in best and best[which][2] >= item.size:
        return
    first = max(0, start - item.size)
    region = words[first : start + span + item.size]
    lcs = item.common(region, least_of(PARAPHRASE, item.size))
    share = lcs / item.size
    answered = share >= PARAPHRASE and item.answered(region)
    if (share >= item.same or answered) and (which not in best or lcs > best[which][2]):
        best[which] = (item_id, near, lcs, share, answered, first)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text has no leak, with all their columns, null and repeated ids as others.

    Whether a row goes depends on its text alone, so rows are matched by its digest.
    """
    digest = F.sha2(F.encode(docs["text"], "UTF-8"), 256)
    hit = settle(_leaks(docs.select(digest.alias("__leak"), "text"), items).select("__leak").distinct(), "leaks")
    return docs.join(hit, digest == hit["__leak"], "left_anti")
