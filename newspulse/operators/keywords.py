"""Term statistics: frequencies, TF-IDF, class words, Zipf and Heaps fits.

Operators take a table with one row per document and an array of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import fixed, text
from newspulse.operators.rows import exploded
from newspulse.session import settle
from newspulse.operators.ranking import expand_ranks, rank_ranges, running_totals, top_k_per_group

TOKENS_AT_ONCE = 4_000_000  # tokens of rows whose pairs a task tells apart at a time
ROWS_AT_ONCE = 100_000  # terms a task sends on at a time


def word_counts(docs: DataFrame, tokens: Column | str = "tokens") -> DataFrame:
    return exploded(docs, array=tokens, name="word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, n: int = 30) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc("word")).limit(n)


def _terms(docs: DataFrame, tokens: str) -> DataFrame:
    """(term, n): each word and bigram once per batch of rows, and the batch's rows and tokens.

    The first letter of a term tells documents (d), tokens (t), words (w) and
    bigrams (b); n is 0 for the last two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"term": ["d", "t"], "n": pa.array([len(size), size.sum()], pa.int64())})
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // TOKENS_AT_ONCE)) + 1):
                if len(part):
                    flat = lists.slice(part[0], len(part)).flatten().dictionary_encode()
                    words, at = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
                    followed = np.ones(len(at), bool)
                    followed[np.cumsum(size[part][size[part] > 0]) - 1] = False  # the last token of a row
                    first = np.flatnonzero(followed)
                    pairs = np.unique(at[first] * max(1, len(words)) + at[first + 1])
                    left, right = (words.take(pa.array(x)) for x in divmod(pairs, max(1, len(words))))
                    for terms in (
                        pc.binary_join_element_wise("w", words, ""),
                        pc.binary_join_element_wise(pc.binary_join_element_wise("b", left, ""), right, " "),
                    ):
                        for k in range(0, len(terms), ROWS_AT_ONCE):
                            some = terms.slice(k, ROWS_AT_ONCE)
                            yield pa.RecordBatch.from_arrays([some, pa.array(np.zeros(len(some), np.int64))], ["term", "n"])

    return docs.select(tokens).mapInArrow(run, "term string, n long")


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Documents, tokens, distinct words and distinct bigrams from one scan.

    Tokens are numbered inside a task, so that pairs are told apart as whole
    numbers and only the different ones of a batch are made strings and shuffled.
    """
    per_term = _terms(docs, tokens).groupBy("term").agg(F.sum("n").alias("n"))
    kind = F.substring("term", 1, 1)
    when = lambda k, value: F.coalesce(F.sum(F.when(kind == k, value)), F.lit(0))
    return per_term.agg(
        when("d", F.col("n")).alias("documents"),
        when("t", F.col("n")).alias("tokens"),
        when("w", F.lit(1)).alias("distinct_words"),
        when("b", F.lit(1)).alias("distinct_bigrams"),
    )


def tfidf_vocabulary(counted: DataFrame, max_terms: int = 200, min_df: int = 5, max_df: float = 0.8) -> DataFrame:
    """At most ``max_terms`` rows (word, idf) from documents as (_row, counts): the size is fixed by the limit.

    Each document emits a word once with its count, so only partial sums per
    word are shuffled.
    """
    terms = exploded(counted, array="counts", name="t")
    per_word = terms.groupBy(F.col("t.word").alias("word")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("t.n").alias("cf")
    )
    total = counted.agg(F.count(F.lit(1)).alias("total")).scalar()
    kept = (
        per_word.withColumn("total", total)
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("total")))
        .orderBy(F.desc("cf"), F.asc("word"))
        .limit(max_terms)
    )
    return kept.select("word", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_top(docs: DataFrame, tokens: str = "tokens", n: int = 30, **limits) -> DataFrame:
    """Mean TF-IDF weight per term over all documents, the ``n`` highest.

    Texts are counted once into a table of term counts. The vocabulary is a
    bounded list that every task gets; a document's known words meet for its
    norm, at most one row per word of the vocabulary.
    """
    counted = settle(docs.select(F.monotonically_increasing_id().alias("_row"), text.term_counts(tokens).alias("counts")), "term-counts")
    vocabulary = settle(tfidf_vocabulary(counted, **limits), "vocabulary")
    total = counted.agg(F.count(F.lit(1))).scalar()
    terms = exploded(counted, "_row", array="counts", name="t").select("_row", "t.word", "t.n")
    known = terms.join(F.broadcast(vocabulary), "word").select("_row", "word", (F.col("n") * F.col("idf")).alias("x"))
    rows = known.groupBy("_row").agg(F.collect_list(F.struct("word", "x")).alias("ws"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return (
        exploded(rows, "norm", array="ws", name="w")
        .groupBy(F.col("w.word").alias("word"))
        .agg(F.sum(F.col("w.x") / F.col("norm")).alias("mass"))
        .select("word", (F.col("mass") / total).alias("score"))
        .orderBy(F.desc("score"), F.asc("word"))
        .limit(n)
    )


def class_top_words(docs: DataFrame, label: str, tokens: str = "tokens", n: int = 20) -> DataFrame:
    """The ``n`` most frequent words of every class."""
    counts = (
        exploded(docs.where(F.col(label).isNotNull()), F.col(label).alias("label"), array=tokens, name="word")
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k_per_group(counts, ["label"], [F.desc("n"), F.asc("word")], n, "rank")


def class_word_weights(docs: DataFrame, label: str, tokens: str = "tokens", n: int = 100) -> DataFrame:
    """Word-cloud weights: counts relative to the class maximum."""
    from pyspark.sql import Window

    top = class_top_words(docs, label, tokens, n)
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy("label"))).drop("rank")


def zipf_curve(counts: DataFrame, count_col: str = "n") -> DataFrame:
    """(rank, freq) for every word, ranks 1..n without ties."""
    return expand_ranks(rank_ranges(counts, count_col))


def zipf_fit(curve: DataFrame) -> DataFrame:
    x, y = F.log10("rank"), F.log10("freq")
    return curve.agg(
        F.count(F.lit(1)).alias("words"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    ).withColumn("verdict", F.when(F.abs(F.col("slope") + 1) < 0.3, "holds").otherwise("partial"))


def heaps_curve(docs: DataFrame, order: str, tokens: str = "tokens") -> DataFrame:
    """Running token count and running vocabulary per document, in order.

    A word is new in the first document that holds it; documents without
    tokens keep a point.
    """
    sizes = docs.select(F.col(order), F.size(tokens).cast("long").alias("tokens"), F.lit(0).cast("long").alias("new"))
    first = (
        exploded(docs, order, array=F.array_distinct(tokens), name="word")
        .groupBy("word")
        .agg(F.min(order).alias(order))
    )
    fresh = first.select(F.col(order), F.lit(0).cast("long").alias("tokens"), F.lit(1).cast("long").alias("new"))
    points = sizes.unionByName(fresh).groupBy(order).agg(F.sum("tokens").alias("tokens"), F.sum("new").alias("new"))
    return running_totals(points, order, {"tokens": "total_tokens", "new": "vocabulary"}).select(
        order, "total_tokens", "vocabulary"
    )


def heaps_fit(curve: DataFrame) -> DataFrame:
    at_least_one = lambda c: F.log10(F.greatest(F.col(c), F.lit(1)))
    x, y = at_least_one("total_tokens"), at_least_one("vocabulary")
    return curve.agg(
        F.count(F.lit(1)).alias("points"), F.max("total_tokens").alias("tokens"), F.regr_slope(y, x).alias("beta")
    ).withColumn("verdict", F.when(F.col("beta").between(0.3, 0.7), "holds").otherwise("partial"))


def doc_keywords(docs: DataFrame, content: str, pattern: str = fixed.HANGUL_WORD, n: int = 5, out: str = "keywords") -> DataFrame:
    """Each document's ``n`` most frequent words, counted inside its row."""
    return docs.withColumn(out, text.top_terms(text.term_counts(text.words(content, pattern)), n))


def tagged_tokens(
    tokens_long: DataFrame, tags: DataFrame, allowed: Sequence[str] = fixed.KEPT_TAGS
) -> DataFrame:
    """Keep token rows whose dictionary tag, cut to 3 characters, is allowed.

    The allowed words are settled first: a dictionary of usual size is then
    broadcast and the tokens are not shuffled. Beyond that size AQE splits
    the partitions of very frequent words.
    """
    kept = settle(tags.where(F.substring("tag", 1, 3).isin(list(allowed))).select("word").distinct(), "allowed-words")
    return tokens_long.join(kept, "word", "left_semi")
