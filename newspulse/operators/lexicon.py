"""Lexicon scores with a lexicon table of any size, in one pass over a text.

The words of the table become a trie in numpy tables, which all places of some
texts descend at once. Occurrences of one word don't overlap each other, those
of different words may. A table of up to MAX_BYTES goes to every task; a larger
one is dealt into parts of that size, each part goes over the texts, and the
parts' scores are added up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from newspulse.functions import text
from newspulse.session import settle

#: Bytes of words in one trie; it takes some fifty times as much memory.
MAX_BYTES = 4 << 20
#: Bytes of texts that meet a part of a lexicon at once, at least.
TEXT_BYTES = 8 << 20
#: Letters of texts that descend the trie at once.
LETTERS = 1 << 19
#: Cells up to which a table has a place for every pair, beyond that the pairs alone.
CELLS = 1 << 20


class Automaton:
    """Trie of the words by length: node and letter give the node of the next length."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.words = list(words)
        self.weights = np.array([weight for _, weight in self.words], np.int64)
        self.sizes = np.array([len(word) for word, _ in self.words], np.int64)
        #: Words that may overlap themselves.
        self.own_overlap = np.array([_has_border(word) for word, _ in self.words], bool)
        codes, starts = _codes([word for word, _ in self.words])
        seen = np.unique(codes)
        self.letters = np.zeros(0x110000, np.int32)  # 0: in no word
        self.letters[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        #: By length: the next nodes by node and letter, or the pairs that have one, and the word that ends in a node.
        self.levels: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]] = []
        alive, node, nodes = np.arange(len(self.words)), np.zeros(len(self.words), np.int64), 1
        for length in range(int(self.sizes.max(initial=0))):
            longer = self.sizes[alive] > length
            alive, node = alive[longer], node[longer]
            pairs, following = np.unique(node * self.width + self.letters[codes[starts[alive] + length]], return_inverse=True)
            table = None
            if nodes * self.width <= CELLS:
                table = np.full(nodes * self.width, -1, np.int32)
                table[pairs] = np.arange(len(pairs))
            ends = np.full(len(pairs), -1, np.int64)
            last = self.sizes[alive] == length + 1
            ends[following[last]] = alive[last]
            self.levels.append((table, pairs, ends))
            node, nodes = following, len(pairs)

    def _found(self, letters: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, words) of the words that start at one of the first places."""
        at, node = np.flatnonzero(letters[:places]), np.zeros(1, np.int64)
        node = np.broadcast_to(node, at.shape)
        for length, (table, pairs, ends) in enumerate(self.levels):
            there = at + length
            if at.size and there[-1] >= len(letters):
                inside = there < len(letters)
                at, node, there = at[inside], node[inside], there[inside]
            pair = node * self.width + letters[there]
            if table is None:
                following = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                known = pairs[following] == pair
            else:
                following = table[pair]
                known = following >= 0
            at, node = at[known], following[known].astype(np.int64)
            if not at.size:
                return
            word = ends[node]
            whole = word >= 0
            yield at[whole], word[whole]

    def occurrences(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of texts, numbers of words) of all occurrences that don't overlap an earlier one of that word."""
        if not self.levels:
            return
        codes, starts = _codes(texts)
        letters = self.letters[codes]
        owner = np.repeat(np.arange(len(texts)), np.diff(starts, append=len(codes)))
        letters[starts[1:] - 1] = 0  # the blank between two texts
        again: list[tuple[np.ndarray, np.ndarray]] = []
        for begin in range(0, len(letters), LETTERS):
            for at, word in self._found(letters[begin : begin + LETTERS + len(self.levels)], LETTERS):
                at = at + begin
                own = self.own_overlap[word]
                if own.any():
                    again.append((at[own], word[own]))
                    at, word = at[~own], word[~own]
                yield owner[at], word
        if again:
            at, word = (np.concatenate(x) for x in zip(*again, strict=True))
            order = np.lexsort((at, word))
            at, word = at[order], word[order]
            kept = self._apart(at, word)
            yield owner[at[kept]], word[kept]

    def _apart(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of occurrences by word and place, those that no kept one before of that word reaches into."""
        kept = np.ones(len(at), bool)
        size = self.sizes[word]
        near = np.flatnonzero((word[1:] == word[:-1]) & (at[1:] - at[:-1] < size[1:])) + 1
        before, free = -1, 0
        for i in near.tolist():
            if i - 1 != before:
                free = at[i - 1] + size[i]
            before = i
            if at[i] < free:
                kept[i] = False
            else:
                free = at[i] + size[i]
        return kept

    def counts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of texts, numbers of words, occurrences), by text and word."""
        cells, some = len(texts) * len(self.words), (t * len(self.words) + w for t, w in self.occurrences(texts))
        if cells <= 8 * CELLS:
            sums = np.zeros(cells, np.int64)
            for x in some:
                np.add.at(sums, x, 1)
            at = np.flatnonzero(sums)
            n = sums[at]
        else:
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *some]), return_counts=True)
        return *np.divmod(at, max(1, len(self.words))), n

    def hits(self, content: str) -> dict[int, int]:
        """Occurrences of every word in a text that don't overlap an earlier one of that word."""
        _, word, n = self.counts([content])
        return dict(zip(word.tolist(), n.tolist(), strict=True))

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Weight times occurrences, added up for every text."""
        sums = np.zeros(len(texts), np.int64)
        for a, b in _groups(texts):
            for owner, word in self.occurrences(texts[a:b]):
                np.add.at(sums, a + owner, self.weights[word])
        return sums


def _has_border(word: str) -> bool:
    """Whether a start of the word, not all of it, is also its end."""
    back = [0] * len(word)
    k = 0
    for i in range(1, len(word)):
        while k and word[i] != word[k]:
            k = back[k - 1]
        k += word[i] == word[k]
        back[i] = k
    return k > 0


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, a blank after each but the last, and where each starts."""
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes, np.cumsum(sizes) - sizes


def _groups(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of some LETTERS together, or a single longer one."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > LETTERS:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def usable(lexicon: DataFrame) -> DataFrame:
    """(word, weight): weights of a word that comes twice are added; null or empty words and null weights are left out."""
    return lexicon.where("word <> '' AND weight IS NOT NULL").groupBy("word").agg(F.sum(F.col("weight").cast("long")).alias("weight"))


def table_score(
    docs: DataFrame, lexicon: DataFrame, weighted: dict[str, int], out: str = "score", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Adds ``out``: the sum of weight times occurrences over the words of (word, weight).

    ``weighted`` gives the text columns and the factor of each, as
    ``{"title": 2, "content": 1}``. A null text counts as empty.
    """
    known, parts = _parts(lexicon, max_bytes)
    factors = list(weighted.values())
    texts = [text.text_or_empty(c) for c in weighted]
    if parts == 1:
        return docs.withColumn(out, _scorer(_collected(known), factors)(*texts))

    def score(frame: pd.DataFrame, automaton: Automaton) -> pd.DataFrame:
        return pd.DataFrame({"_row": frame["_row"], "n": _weighted(automaton, [frame[f"t{i}"] for i in range(len(factors))], factors)})

    placed = _numbered(docs)
    sums = _by_parts(placed, texts, known, parts, max_bytes, score, "_row long, n long").groupBy("_row").agg(F.sum("n").alias("_n"))
    return placed.join(sums, "_row").select(*docs.columns, F.col("_n").alias(out))


def word_hits(docs: DataFrame, lexicon: DataFrame, key: str, content: Column | str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, word, n) for every lexicon word in a text, without overlaps of a word with itself."""
    known, parts = _parts(lexicon, max_bytes)
    texts = [text.text_or_empty(content)]
    if parts == 1:
        rows = docs.select(F.col(key).alias("key"), texts[0].alias("text"))
        kind = StructType([StructField(key, rows.schema["key"].dataType), StructField("word", StringType()), StructField("n", IntegerType())])
        return rows.mapInArrow(_counter(_collected(known), key), kind)

    def count(frame: pd.DataFrame, automaton: Automaton) -> pd.DataFrame:
        texts, numbers, every = frame["t0"].tolist(), frame["_row"].to_numpy(), np.array([w for w, _ in automaton.words], object)
        found = [(a + owner, word, n) for a, b in _groups(texts) for owner, word, n in [automaton.counts(texts[a:b])]]
        none = np.zeros(0, np.int64)
        owner, word, n = (np.concatenate(x) for x in zip((none, none, none), *found, strict=True))
        return pd.DataFrame({"_row": numbers[owner], "word": every[word], "n": n})

    placed = _numbered(docs)
    hits = _by_parts(placed, texts, known, parts, max_bytes, count, "_row long, word string, n int")
    return placed.select("_row", key).join(hits, "_row").select(key, "word", "n")


def _parts(lexicon: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    known = settle(usable(lexicon), "lexicon")
    size = known.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    return known, max(1, -(-size // max_bytes))


def _collected(known: DataFrame) -> list[tuple[str, int]]:
    return [(r.word, r.weight) for r in known.select("word", "weight").collect()]


def _numbered(docs: DataFrame) -> DataFrame:
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()), "texts-to-score")


def _by_parts(placed: DataFrame, texts: list[Column], known: DataFrame, parts: int, max_bytes: int, work, schema: str) -> DataFrame:
    """``work`` for every share of the texts with every part of the lexicon.

    Texts and words are both dealt by hash, so a task holds about ``max_bytes``
    of words and 16 times as many of texts, or TEXT_BYTES if that is more, so
    that small parts aren't repeated for ever more shares; nothing passes
    through the driver.
    """
    columns = [t.alias(f"t{i}") for i, t in enumerate(texts)]
    size = placed.agg(F.coalesce(F.sum(sum(F.octet_length(t) for t in texts).cast("long")), F.lit(0))).first()[0]
    shares = max(1, -(-size // max(TEXT_BYTES, 16 * max_bytes)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(int(n))).cast("int")
    left = placed.select("_row", *columns, of("_row", shares).alias("share"), every(parts).alias("part"))
    right = known.select("word", "weight", of("word", parts).alias("part"), every(shares).alias("share"))

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        return work(docs, Automaton(zip(words["word"], words["weight"], strict=True)))

    return left.groupBy("share", "part").cogroup(right.groupBy("share", "part")).applyInPandas(run, schema)


def _weighted(automaton: Automaton, columns: Iterable[pd.Series], factors: list[int]) -> pd.Series:
    return pd.Series(sum(f * automaton.scores(c.tolist()) for f, c in zip(factors, columns, strict=True)))


def _scorer(entries: list[tuple[str, int]], factors: list[int]):
    @F.pandas_udf("long")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        automaton = Automaton(entries)
        for batch in batches:
            yield _weighted(automaton, batch, factors)

    @F.pandas_udf("long")
    def score_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(entries)
        for batch in batches:
            yield _weighted(automaton, (batch,), factors)

    return score if len(factors) > 1 else score_one


def _counter(entries: list[tuple[str, int]], key: str):
    """(key, word, n) from (key, text), some texts at a time, so that no task holds the hits of a whole batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, every = Automaton(entries), pa.array([word for word, _ in entries], pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                owner, word, n = automaton.counts(texts[a:b])
                columns = [batch.column(0).take(pa.array(a + owner)), every.take(pa.array(word)), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "word", "n"])

    return count
