"""Segmentation of words by a dictionary table of (word, tag, cost).

A run of letters is cut into dictionary words and unknown letters so that the
costs add up to the least; ties go to fewer pieces, then to the longer last
piece. A dictionary of up to MAX_BYTES goes to every task as a trie. A larger
one stays a table: the stretches of all distinct runs are joined with it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.functions import fixed, text
from newspulse.session import settle

UNKNOWN_COST, UNKNOWN_TAG = 20, "UNK"
#: Bytes of a dictionary beyond which it isn't sent to the tasks; a trie takes about ten times as much memory.
MAX_BYTES = 32 << 20
REMEMBERED = 200_000  # runs whose pieces a task keeps
ROWS_AT_ONCE = 256  # texts whose pieces a task holds
BLOCK_BITS = 8  # 256 neighbouring texts look up their runs together
BUCKET_BITS = 24  # of bytes of text for which the runs make one more bucket
MIN_BUCKETS = 64  # so that tasks have a like number of them
FILTER_BITS = 25  # at most so many places, as a power of two, in the table that tells stretches that are no words
LETTERS_AT_ONCE = 1_000_000  # of runs whose stretches are hashed together
PLACES_AT_ONCE = 1_000_000  # runs of texts that are looked up together
#: Types that pass through Arrow as they are; columns of others are joined to the pieces by row.
PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType)
#: While tables are settled: their shuffles go when they are written, and texts are packed closer.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
PIECES = "array<struct<word:string,tag:string,run:int>>"
Cut = list[tuple[int, int, str]]  # (start, end, tag)
#: (end, cost, tag) of the dictionary words that start at a place of a run.
Starting = Callable[[str, int], Iterable[tuple[int, int, str]]]


class Trie:
    """Dictionary words by their letters; the entry under "" ends a word."""

    def __init__(self, entries: Iterable[tuple[str, str, int]]):
        self.root: dict = {}
        for word, tag, cost in entries:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = (cost, tag)

    def starting(self, run: str, start: int) -> list[tuple[int, int, str]]:
        node, found = self.root, []
        for i in range(start, len(run)):
            node = node.get(run[i])
            if node is None:
                break
            end = node.get("")
            if end is not None:
                found.append((i + 1, *end))
        return found


def cut(run: str, starting: Starting, unknown_cost: int = UNKNOWN_COST) -> Cut:
    """The cheapest way through a run; neighbouring unknown letters make one piece."""
    costs: list[float] = [0, *[float("inf")] * len(run)]
    pieces, starts, tags = [0] * (len(run) + 1), [0] * (len(run) + 1), [""] * (len(run) + 1)
    for i in range(len(run)):
        cost, n = costs[i], pieces[i] + 1
        for j, more, tag in (*starting(run, i), (i + 1, unknown_cost, UNKNOWN_TAG)):
            total = cost + more
            # Starts come in order, so an equal way is that of a longer last piece or the same piece.
            if total < costs[j] or total == costs[j] and (n < pieces[j] or n == pieces[j] and starts[j] == i and tags[j] == UNKNOWN_TAG):
                costs[j], pieces[j], starts[j], tags[j] = total, n, i, tag
    out: Cut = []
    j = len(run)
    while j:
        i, tag = starts[j], tags[j]
        if tag == UNKNOWN_TAG and out and out[-1][2] == UNKNOWN_TAG:
            out[-1] = (i, out[-1][1], tag)
        else:
            out.append((i, j, tag))
        j = i
    return out[::-1]


def usable(dictionary: DataFrame) -> DataFrame:
    """(word, tag, cost): each word once with its least cost, then least tag; nulls and empty words are left out."""
    known = dictionary.where("word <> '' AND cost IS NOT NULL").groupBy("word").agg(
        F.min(F.struct(F.col("cost").cast("long").alias("cost"), F.coalesce("tag", F.lit("")).alias("tag"))).alias("m"))
    return known.select("word", "m.tag", "m.cost")


def segment(
    docs: DataFrame, dictionary: DataFrame, content: Column | str, pattern: str = fixed.LETTER_WORD,
    unknown_cost: int = UNKNOWN_COST, max_bytes: int = MAX_BYTES, out: str = "pieces",
) -> DataFrame:
    """Adds ``out``: the pieces (word, tag, run) of every run of ``pattern``, in order.

    ``run`` numbers the runs of the text from 0. Pieces that no dictionary
    word covers have the tag UNKNOWN_TAG. A null text has no pieces. The two
    ways of meeting the dictionary give the same pieces.
    """
    with _lean(docs.sparkSession):
        known = settle(usable(dictionary), "dictionary")
    size = known.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("tag") + 16), F.lit(0))).first()[0]
    runs = text.words(content, pattern)
    if size <= max_bytes:
        entries = [(r.word, r.tag, r.cost) for r in known.collect()]
        return docs.withColumn(out, _zipped(_cutter(entries, unknown_cost)(runs)))
    return _by_join(docs, known, content, runs, unknown_cost, out)


def _zipped(lists: Column) -> Column:
    return F.arrays_zip(lists["word"].alias("word"), lists["tag"].alias("tag"), lists["run"].alias("run")).cast(PIECES)


def _cutter(entries: list[tuple[str, str, int]], unknown_cost: int):
    kind = "word array<string>, tag array<string>, run array<int>"

    @F.pandas_udf(kind)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(entries)
        seen: dict[str, tuple[list[str], list[str]]] = {}
        for batch in batches:
            rows = []
            for runs in batch:
                words, tags, places = [], [], []
                for k, run in enumerate(runs):
                    found = seen.get(run)
                    if found is None:
                        parts = cut(run, trie.starting, unknown_cost)
                        found = [run[i:j] for i, j, _ in parts], [tag for _, _, tag in parts]
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        if len(run) <= 64:
                            seen[run] = found
                    words += found[0]
                    tags += found[1]
                    places += [k] * len(found[0])
                rows.append((words, tags, places))
                if len(rows) == ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["word", "tag", "run"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["word", "tag", "run"])

    return pieces


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _packed(value: list) -> bytes:
    return zlib.compress(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode(), 1)


def _unpacked(packed: bytes) -> list:
    return json.loads(zlib.decompress(packed))


def _asker(buckets: int):
    """Of texts (_block, _runs) in their order: the different runs of each block, by bucket of the run."""

    def by_bucket(block: int, runs: set[str]) -> pa.RecordBatch:
        found: dict[int, list[str]] = {}
        for run in sorted(runs):
            found.setdefault(zlib.crc32(run.encode()) % buckets, []).append(run)
        return pa.RecordBatch.from_arrays(
            [pa.array([*found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([*map(_packed, found.values())], pa.binary())],
            ["_bucket", "_block", "runs"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, set()
        for batch in batches:
            blocks, lists = batch["_block"].to_numpy(), batch["_runs"]
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if block != blocks[i] and held:
                    yield by_bucket(block, held)
                    held = set()
                block = int(blocks[i])
                held.update(lists.slice(i, j - i).flatten().unique().to_pylist())
        if held:
            yield by_bucket(block, held)

    return ask


def _united(asked: pa.Table) -> pa.Table:
    """The different runs of a bucket."""
    runs: set[str] = set()
    for packed in asked["runs"]:
        runs.update(_unpacked(packed.as_py()))
    return pa.table({"_bucket": asked["_bucket"][:1], "runs": pa.array([_packed(sorted(runs))], pa.binary())})


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64)


def _stretches(runs: Sequence[str], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1, 2, ... letters: where in the runs, put together, a stretch of so many starts, and its hash."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    codes, left = _codes("".join(runs)), np.repeat(sizes.cumsum(), sizes)  # end of the run of each letter
    left -= np.arange(len(codes))
    at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        fit = left[at] >= n
        at, hashes = at[fit], hashes[fit]
        if not len(at):
            return
        hashes = hashes * np.uint64(0x100000001B3) + codes[at + (n - 1)] + np.uint64(1)
        yield n, at, hashes


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _filter(known: DataFrame, n: int) -> bytes:
    """A table of bits, one at the hash of each word, so that few stretches that are no words are joined."""
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum()
            for k, at, hashes in _stretches(words, max(map(len, words), default=0)):
                whole = np.isin(at + k, ends) & np.isin(at, np.concatenate([[0], ends]))
                yield pa.RecordBatch.from_arrays([pa.array(_places(hashes[whole], bits).astype(np.int64))], ["at"])

    rows = known.select("word").mapInArrow(place, "at long").groupBy(F.shiftright("at", 6).alias("k")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["k"].to_numpy()] = rows["bits"].to_numpy()
    return table.astype("<i8").tobytes()


def _prober(table: bytes, longest: int):
    """(_bucket, word): stretches of a bucket's runs that may be words, each once for LETTERS_AT_ONCE letters."""
    bits = (8 * len(table)).bit_length() - 1

    def some(runs: list[str], known: np.ndarray) -> set[str]:
        letters, words = "".join(runs), set()
        for n, at, hashes in _stretches(runs, longest):
            place = _places(hashes, bits)
            hit = known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            words.update(letters[i:i + n] for i in at[hit.astype(bool)].tolist())
        return words

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table, np.uint8)
        for batch in batches:
            for bucket, packed in zip(batch["_bucket"].to_pylist(), batch["runs"], strict=True):
                runs = _unpacked(packed.as_py())
                share = np.fromiter(map(len, runs), np.int64, len(runs)).cumsum() // LETTERS_AT_ONCE
                edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(runs)]
                for i, j in zip(edges, edges[1:]):
                    words = some(runs[i:j], known)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket] * len(words), pa.int32()), pa.array([*words], pa.string())], ["_bucket", "word"])

    return probe


def _solver(unknown_cost: int):
    """Cuts the runs of a bucket by the words in them, each run once, and answers each block."""

    def solve(asked: pa.Table, words: pa.Table) -> pa.Table:
        trie = Trie(zip(words["word"].to_pylist(), words["tag"].to_pylist(), words["cost"].to_pylist(), strict=True))
        seen: dict[str, tuple[list[str], list[str]]] = {}
        answers = []
        for packed in asked["runs"]:
            counts, parts, tags = [], [], []
            for run in _unpacked(packed.as_py()):
                found = seen.get(run)
                if found is None:
                    way = cut(run, trie.starting, unknown_cost)
                    found = seen[run] = [run[i:j] for i, j, _ in way], [tag for _, _, tag in way]
                counts.append(len(found[0]))
                parts += found[0]
                tags += found[1]
            answers.append(_packed([counts, parts, tags]))
        return pa.table({"_block": asked["_block"], "cuts": pa.array(answers, pa.binary())})

    return solve


def _put(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Adds _pieces to the texts of a block."""
    counts, words, tags = [], [], []
    for packed in answers["cuts"]:
        for held, more in zip((counts, words, tags), _unpacked(packed.as_py()), strict=True):
            held += more
    pieces = np.array(counts, np.int64)
    edges = pa.array(np.concatenate([[0], pieces.cumsum()]), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, pa.array(some, pa.string())) for some in (words, tags)]
    runs = pc.binary_join(lists[0], "")  # the pieces of a run are all of it; one that two tasks asked for is there twice
    parts = []
    for some in _slices(texts):
        asked = some["_runs"].combine_chunks()
        n = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], n.cumsum()])
        at = pc.index_in(asked.flatten(), value_set=runs)
        if at.null_count:
            raise ValueError("a run of a text has no pieces")
        many = pieces[at.to_numpy()]
        offsets = pa.array(np.concatenate([[0], many.cumsum()])[ends], pa.int32())
        numbers = np.repeat(np.arange(len(at)) - np.repeat(ends[:-1], n), many)
        each = pa.StructArray.from_arrays([*(x.take(at).flatten() for x in lists), pa.array(numbers, pa.int32())], ["word", "tag", "run"])
        parts.append(some.drop_columns("_runs").append_column("_pieces", pa.ListArray.from_arrays(offsets, each)))
    return pa.concat_tables(parts)


def _slices(texts: pa.Table) -> Iterator[pa.Table]:
    """Rows that have no more than PLACES_AT_ONCE runs together, or one row."""
    n = pc.list_value_length(texts["_runs"]).to_numpy()
    start = total = 0
    for k, more in enumerate(n.tolist()):
        if total + more > PLACES_AT_ONCE and k > start:
            yield texts.slice(start, k - start)
            start, total = k, 0
        total += more
    yield texts.slice(start)


def _by_join(docs: DataFrame, known: DataFrame, content: Column | str, runs: Column, unknown_cost: int, out: str) -> DataFrame:
    """For a dictionary of any size: distinct runs, their stretches, the words among them, and back.

    Runs are dealt over buckets by a hash, texts over blocks of neighbours. A
    block asks each bucket for its different runs in one packed row and gets
    one back; a bucket meets the words in its runs once and cuts each run
    once. The texts are shuffled once, and come out with their pieces.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _lean(spark):
        longest, n = known.agg(F.coalesce(F.max(F.char_length("word")), F.lit(1)), F.count(F.lit(1))).first()
        placed = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "documents-to-segment")
        size = placed.agg(F.sum(F.octet_length(text.as_col(content)).cast("long"))).first()[0] or 0
        buckets = max(MIN_BUCKETS, size >> BUCKET_BITS)
        block = F.shiftright("_row", BLOCK_BITS).alias("_block")
        each = settle(placed.select(block, runs.alias("_runs")).mapInArrow(_asker(buckets), "_bucket int, _block long, runs binary"), "runs-by-block")
        distinct = settle(each.groupBy("_bucket").applyInArrow(_united, "_bucket int, runs binary"), "distinct-runs")
        # Runs are small and the work on them is not, so they keep as many partitions as a shuffle has.
        words = distinct.repartition(tasks).mapInArrow(_prober(_filter(known, n), longest), "_bucket int, word string").join(known, "word")
        cuts = settle(
            each.repartition(tasks, "_bucket").groupBy("_bucket").cogroup(words.groupBy("_bucket")).applyInArrow(_solver(unknown_cost), "_block long, cuts binary"),
            "cut-runs")
    plain = [f for f in placed.schema if isinstance(f.dataType, PLAIN)]
    others = [c for c in docs.columns if c not in {f.name for f in plain}]
    # The runs are found after the texts are shuffled and sorted, so that both have the texts alone.
    texts = placed.select(block, *docs.columns, "_row").repartition("_block").sortWithinPartitions("_block").select(
        "_block", *[f.name for f in plain], runs.alias("_runs"))
    schema = T.StructType([T.StructField("_block", T.LongType()), *plain, T.StructField("_pieces", T.DataType.fromDDL(PIECES))])
    found = texts.groupBy("_block").cogroup(cuts.groupBy("_block")).applyInArrow(_put, schema)
    if others:
        found = found.join(placed.select("_row", *others), "_row")
    return found.select(*docs.columns, F.col("_pieces").alias(out))


def kept_words(
    pieces: Column | str, allowed: Sequence[str] = fixed.KEPT_TAGS, stopwords: Sequence[str] = fixed.STOPWORDS, min_length: int = 2
) -> Column:
    """Words of the pieces whose tag, cut to 3 characters, is allowed, without stopwords and short ones."""

    def keep(p: Column) -> Column:
        ok = F.substring(p["tag"], 1, 3).isin(list(allowed)) & (F.char_length(p["word"]) >= min_length)
        return ok & ~p["word"].isin(list(stopwords)) if stopwords else ok

    return F.transform(F.filter(text.as_col(pieces), keep), lambda p: p["word"])
