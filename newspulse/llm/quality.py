"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees grown on resampled rows give conjunctive rules (the paths to
their nodes). A logistic model with a lasso penalty weighs them, most weights
become zero, and the rest is compiled into one Spark column expression over
the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from newspulse.llm.common import held_out, slices, utf8
from newspulse.session import settle

STATS = (
    "upper", "digit", "space", "sentence_marks", "symbols", "non_ascii", "newlines", "entropy", "word_length",
    "distinct_words", "top_word", "marked_words", "repeated_lines", "longest_line", "log_words",
)
#: Labelled rows the classifier is fitted on, taken in order of a hash.
FIT_ROWS = 20_000
TREES, LEVELS, LEAF = 40, 3, 10
PENALTY, STEPS = 0.002, 400

_CLASS = np.zeros((256, 7))
for _c in range(256):
    _x = chr(_c)
    _CLASS[_c] = [
        65 <= _c <= 90, 48 <= _c <= 57, _x in " \t\n\r\x0b\x0c", _x in ".,;:?!'\"-()",
        33 <= _c < 127 and not _x.isalnum() and _x not in ".,;:?'\"-()", _c >= 128, _c == 10]


def text_stats(text: str | None) -> tuple[float, ...]:
    """The numbers of STATS for one whole text; all zero for an empty one."""
    raw = utf8(text)
    if not raw:
        return (0.0,) * len(STATS)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = hist @ _CLASS / len(raw)
    p = hist[hist > 0] / len(raw)
    words = raw.lower().split()
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(k for w, k in counts.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,;:?'\")"))
    lines = [x for x in raw.split(b"\n") if x]
    return (
        *shares.tolist(), float(-(p * np.log2(p)).sum()), sum(map(len, words)) / n if n else 0.0,
        len(counts) / n ** 0.8 if n else 0.0, max(counts.values()) / n if n else 0.0, marked / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, max(map(len, lines)) / len(raw) if lines else 0.0,
        float(np.log1p(n)))


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats) for rows of (doc_id, text, held_out); whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 8_000_000):
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"],
                "stats": [list(text_stats(t)) for t in frame["text"]]})

    return docs.select("doc_id", "text", "held_out").mapInPandas(run, "doc_id long, held_out boolean, stats array<double>")


@F.pandas_udf(ArrayType(DoubleType()))
def stats_of(text: pd.Series) -> pd.Series:
    return pd.Series([list(text_stats(t)) for t in text])


class Rule(NamedTuple):
    """All of (statistic, is above, threshold) hold; then ``weight`` counts."""

    parts: tuple[tuple[int, bool, float], ...]
    weight: float


class Model(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]


def _holds(x: np.ndarray, parts: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in parts:
        out &= (x[:, j] > t) == above
    return out


def _grow(x, y, rows, parts, levels, rng, out) -> None:
    """Split ``rows`` at the best of some thresholds; note the path of each child."""
    if not levels or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    rate = y[rows].mean()
    for j in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        v = x[rows, j]
        for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
            up = v > t
            n = int(up.sum())
            if min(n, len(rows) - n) < LEAF:
                continue
            a, b = y[rows][up].mean(), y[rows][~up].mean()
            gain = rate * (1 - rate) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
            if gain > best[0]:
                best = (gain, (int(j), float(t)))
    if best[1] is None:
        return
    j, t = best[1]
    for above in (True, False):
        path = (*parts, (j, above, t))
        out.append(path)
        _grow(x, y, rows[(x[rows, j] > t) == above], path, levels - 1, rng, out)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Rules and weights for statistics ``x`` and labels ``y`` of 0 and 1.

    Without rows the model gives 0.5; with one class, its smoothed rate.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(bias, ())
    rng = np.random.default_rng(seed)
    classes = [np.flatnonzero(y == k) for k in (0, 1)]
    paths: list = []
    for _ in range(TREES):
        # As many rows of either class, so the rarer one shapes the trees too.
        size = min(2000, max(50, min(map(len, classes))))
        rows = np.concatenate([rng.choice(c, size=size) for c in classes])
        _grow(x, y, rows, (), LEVELS, rng, paths)
    paths = list(dict.fromkeys(paths))
    if not paths:
        return Model(bias, ())
    z = np.stack([_holds(x, p) for p in paths], axis=1).astype(float)
    spread = np.maximum(z.std(0), 0.05)
    centred = (z - z.mean(0)) / spread
    # Accelerated proximal gradient steps for the lasso-penalised logistic loss.
    step = 4.0 / max(1e-9, np.linalg.norm(centred, 2) ** 2 / len(y) + 1)
    w, b, pw, momentum = np.zeros(len(paths)), bias, np.zeros(len(paths)), 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(centred @ pw + b))) - y
        new = pw - step * (centred.T @ error / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= step * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pw = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    weights = w / spread
    bias = float(b - (weights * z.mean(0)).sum())
    return Model(bias, tuple(Rule(p, float(v)) for p, v in zip(paths, weights, strict=True) if abs(v) > 1e-6))


def score(model: Model, stats: Column) -> Column:
    """The model as a column expression over the array of statistics."""
    total = F.lit(model.bias)
    for rule in model.rules:
        hit = F.lit(True)
        for j, above, t in rule.parts:
            hit = hit & ((stats[j] > t) if above else (stats[j] <= t))
        total = total + F.when(hit, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows outside the held-out fold.

    Of those, the ``rows`` ids first in the order of a hash are used, so the
    fit is bounded at every size; their texts are read whole. Null labels and
    ids are left out; an id with several labels counts with the smallest.
    """
    known = settle(
        labels.select("doc_id", F.col("quality").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", modulus, rest))
        .groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))), "quality-labels")
    # Only a little more than the sample meets in the last sort.
    share = min(1.0, 1.2 * rows / max(1, known.count()))
    sample = known.where(F.col("_at") < share * (1 << 30)).orderBy("_at", "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` ids
    got = found.select("y", stats_of("text").alias("stats")).limit(4 * rows).collect()
    y = np.array([r.y for r in got], dtype=float)
    x = np.array([r.stats for r in got], dtype=float).reshape(len(got), len(STATS))
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return fit(x[order], y[order])


def classify(docs: DataFrame, model: Model, modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only texts are looked at.

    Null counts as empty and is scored like an empty text; repeated rows each
    give a row, an empty table none. Other columns are not looked at.
    """
    rows = with_stats(docs.select("doc_id", "text", held_out("doc_id", modulus, rest).alias("held_out")))
    s = score(model, F.col("stats"))
    return rows.select("doc_id", "held_out", s.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text the model accepts."""
    return docs.where(score(model, stats_of(docs["text"])) >= 0.5)
