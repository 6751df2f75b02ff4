"""Product codes of vectors; nearest codebook entries are found in a GNAT.

Components become integers, vectors are cut into equal parts, and every part
is replaced by the index of the nearest entry of its codebook. Entries are
searched in a geometric near-neighbour access tree: a node has split points,
every other entry belongs to the nearest of them, and for each pair (split
point, child) the node knows the range of distances from that point to the
child's entries. A query's distance to one split point so rules out whole
children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components stop here, so that squared distances of parts of up to 128 components stay below 2**63.
LARGEST = 1 << 27
FANOUT = 4
#: Relative room for the rounding of square roots; a child is only left out beyond it.
ROOM = 1e-9


class Gnat:
    """Nearest entry by squared Euclidean distance of integers, ties to the lower index.

    Distances to split points and the best distance so far are compared as
    floating-point roots, with ROOM on the side that keeps a child; the entry
    itself is chosen by exact integers.
    """

    def __init__(self, entries: np.ndarray, fanout: int = FANOUT):
        self.entries = entries.astype(np.int64)
        self.root = self._node(np.arange(len(entries)), fanout)

    def _squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a - b) ** 2).sum(axis=-1)

    def _node(self, ids: np.ndarray, fanout: int):
        """(split points, low, high, children); split points are far from each other."""
        if not len(ids):
            return None
        points = self.entries[ids]
        chosen = [0]
        to_chosen = self._squares(points, points[0])
        while len(chosen) < min(fanout, len(ids)):
            to_chosen[chosen] = -1
            chosen.append(int(np.argmax(to_chosen)))
            to_chosen = np.minimum(to_chosen, self._squares(points, points[chosen[-1]]))
        away = np.array([self._squares(points, points[c]) for c in chosen])
        owner = np.argmin(away, axis=0)
        owner[chosen] = np.arange(len(chosen))
        roots = np.sqrt(away.astype(np.float64))
        of = [owner == j for j in range(len(chosen))]
        low = np.array([[r[m].min() for m in of] for r in roots]) * (1 - ROOM)
        high = np.array([[r[m].max() for m in of] for r in roots]) * (1 + ROOM)
        rest = np.ones(len(ids), bool)
        rest[chosen] = False
        children = [self._node(ids[m & rest], fanout) for m in of]
        return ids[chosen], low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        splits, low, high, children = node
        alive = np.ones((len(rows), len(splits)), bool)
        for i, entry in enumerate(splits):
            ask = np.flatnonzero(alive[:, i])
            at = rows[ask]
            square = self._squares(queries[at], self.entries[entry])
            better = (square < best[at]) | ((square == best[at]) & (entry < index[at]))
            best[at[better]], index[at[better]] = square[better], entry
            d, radius = np.sqrt(square.astype(np.float64))[:, None], np.sqrt(best[at].astype(np.float64))[:, None]
            slack = (d + radius) * ROOM
            out = (d - radius - slack > high[i]) | (d + radius + slack < low[i])
            alive[ask] &= ~out
        for j, child in enumerate(children):
            self._visit(child, queries, rows[alive[:, j]], best, index)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): kept rows with components floor(scale * x), at most LARGEST in size."""
    usable = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(
        F.lit(-1.0 * LARGEST), F.least(F.lit(1.0 * LARGEST), x.cast("double") * scale))))).cast("int")
    kept = vectors.select("vec_id", "label", "embedding").where(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda x: usable(x.cast("double"))))
    return kept.select("vec_id", "label", F.transform("embedding", whole).alias("v"))


def _matrix(frame: pd.DataFrame, parts: int) -> np.ndarray:
    """(rows, parts, width) of a frame whose vectors are equally long."""
    return np.stack(frame["v"].to_numpy()).astype(np.int64).reshape(len(frame), parts, -1)


def train(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks as an array (parts, entries, width); None without a usable vector.

    They start as the parts of the vectors with the smallest ids. A round is
    one pass over the vectors; each task sends its sums and counts per entry
    and component, so only ``parts * entries * width`` numbers reach the
    driver. Of equal ids the smaller vector counts first; a null id is last.
    """
    usable = ints.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = usable.orderBy(*order).select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        return None
    size = first[0].n
    fit = usable.where(F.size("v") == size).select("vec_id", "v")
    books = np.array([r.v for r in fit.orderBy(*order).limit(entries).collect()], np.int64)
    books = books.reshape(len(books), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(fit.select("v"), books)
    return books


def _round(fit: DataFrame, books: np.ndarray) -> np.ndarray:
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(b) for b in books]
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)  # the last number is the count
        for frame in frames:
            if not len(frame):
                continue
            data = _matrix(frame, len(books))
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(data[:, p])
                order = np.argsort(index, kind="stable")
                at, start = np.unique(index[order], return_index=True)
                total[p, at, :-1] += np.add.reduceat(data[order, p], start, axis=0)
                total[p, at, -1] += np.diff(np.append(start, len(index)))
        used = np.flatnonzero(total.any(axis=2).ravel().repeat(total.shape[2]))
        yield pd.DataFrame({"at": used.astype(np.int32), "s": total.ravel()[used]})

    shape = (*books.shape[:2], books.shape[2] + 1)
    found = np.zeros(shape, np.int64)
    for r in fit.mapInPandas(sums, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect():
        found.ravel()[r.at] = r.s
    count = found[..., -1:]
    return np.where(count > 0, found[..., :-1] // np.maximum(count, 1), books)


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) for every row of ``ints``; code and error are
    null where the vector isn't as long as those the codebooks are made of."""
    fields = {f.name: f.dataType for f in ints.schema}
    schema = T.StructType([
        T.StructField("vec_id", fields["vec_id"]), T.StructField("label", fields["label"]),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    size = books.shape[0] * books.shape[2]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for frame in frames:
            if not len(frame):
                continue
            data = _matrix(frame, len(books))
            found = [tree.nearest(data[:, p]) for p, tree in enumerate(trees)]
            codes = ["".join(row) for row in digits[np.stack([f[0] for f in found], axis=1)]]
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].astype("Int64"), "label": frame["label"].astype("Int64"), "code": codes,
                "error": np.sum([f[1] for f in found], axis=0)})

    coded = ints.where(F.size("v") == size).mapInPandas(assign, schema)
    other = ints.where(F.size("v") != size).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every kept row of (vec_id, embedding, label).

    Rows with a null vector or a null or non-finite component are dropped.
    Components beyond LARGEST in size (as integers) are taken as LARGEST. The
    usable length is that of the vector with the smallest id whose length is a
    positive multiple of ``parts``; vectors of another length get null code
    and error and do not train. Repeated rows each count; null ids come last
    among the first entries; fewer rows than ``entries`` give as many entries.
    An empty table gives none. Other columns are not looked at.
    """
    ints = settle(integers(vectors, scale), "vector-integers")
    books = train(ints, parts, entries, rounds)
    if books is None:
        return ints.select(
            "vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
            F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = settle(encode(ints, books), "vector-codes")
    per_label = settle(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
