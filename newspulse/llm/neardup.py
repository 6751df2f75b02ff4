"""MinHash near-deduplication with tensored banding.

Two small collections of minhash groups are computed per document; the key of
a table joins one group of the first with one of the second, so m + m groups
serve m * m tables. Documents that share a key are candidates. Candidates are
verified on their full shingle sets, first against both ends of their bucket,
then wherever candidates are still in different components; links form
components by contraction of the graph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.llm.common import mix64, rows_at_once, slices, utf8
from newspulse.llm.hashing import Rolling
from newspulse.session import settle

GROUP = 2  # minhashes of a group; a key has twice as many
MISS = 5e-4  # chance that a pair at the threshold meets in no group of a collection
SIGNATURE = 64  # minhashes kept to estimate a similarity
SLACK = 14  # how far an estimate may fall below the threshold, in minhashes: over 4.5 deviations
CHUNK = 1024  # nodes of an area compared with as many others in one task
ROWS_AT_ONCE, TEXT_AT_ONCE = 1000, 300_000  # rows a task is handed at a time; characters it hashes at a time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SEEDS = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def groups_of(similarity: float) -> int:
    """Groups of a collection such that a pair misses both with at most 2 * MISS."""
    return int(np.ceil(np.log(MISS) / np.log(1 - similarity**GROUP)))


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of ``k`` words of every text.

    Words are lower-cased runs of bytes other than white space. A text of
    fewer words has one shingle, all of its words; one without words none.
    """
    raw = [utf8(t).lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    gap = _SPACE[data]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    word = Rolling(data).of(start, end)
    cuts = np.searchsorted(start, ends, side="right")
    out, a = [], 0
    for b in cuts.tolist():
        w, n = word[a:b], b - a
        a = b
        if n == 0:
            out.append(w)
            continue
        span = min(k, n)
        h = w[: n - span + 1] * _K[0]
        for i in range(1, span):
            h = h + w[i : n - span + 1 + i] * mix64(_K[i % 5] + np.full(1, i, np.uint64))[0]
        if n < k:
            h = h + np.uint64(n)
        out.append(np.unique(mix64(h)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of SIGNATURE hashes over a set, 32 bits each."""
    low = np.full(SIGNATURE, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 4096):
        x = (shingles[a : a + 4096, None] ^ _SEEDS) * _K[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, node, sig) of every row; node names the set, null without one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", TEXT_AT_ONCE):
            sets = shingle_sets(frame["text"].tolist(), k)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                "node": [set_key(s) if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, node binary, sig binary")


def band_keys(nodes: DataFrame, similarity: float) -> DataFrame:
    """(band, node): the keys of all tables for every distinct set."""
    m = groups_of(similarity)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at : at + 2048]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, SIGNATURE).astype(np.uint64)
                g = np.zeros((len(part), 2 * m), np.uint64)
                for j in range(GROUP):
                    g = mix64(g * _K[2] + sig[:, j : 2 * m * GROUP : GROUP] + np.uint64(1))
                table = np.arange(m * m, dtype=np.uint64)
                key = mix64(g[:, :m, None] * _K[3] + g[:, None, m:] * _K[4] + table.reshape(1, m, m))
                yield pd.DataFrame({"band": key.reshape(-1).astype(np.int64), "node": np.repeat(part["node"].to_numpy(), m * m)})

    return nodes.select("node", "sig").mapInPandas(run, "band long, node binary")


def verify(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have at least that percentage in common."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for frame in slices(frames, "tb", TEXT_AT_ONCE):
            sets, good = shingle_sets(frame["tb"].tolist(), k), []
            for a, ta, s in zip(frame["a"], frame["ta"], sets, strict=True):
                if a != last[0]:
                    last = (a, shingle_sets([ta], k)[0])
                both = len(np.intersect1d(last[1], s, assume_unique=True))
                good.append(100 * both >= similarity * (len(last[1]) + len(s) - both))
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    tb = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = tb.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "ta", "b", "tb").mapInPandas(run, "a binary, b binary")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) after joining the ends of ``edges`` (a, b); starts from ``labels``.

    Labels are hooked to their smallest neighbour and followed twice; edges
    inside a component drop out, so the graph shrinks with every round.
    """
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = settle(edges.join(left, "a").join(right, "b").where("la <> lb").select("la", "lb").distinct(), "links")
    while not edges.isEmpty():
        ways = edges.select(F.col("la").alias("x"), F.col("lb").alias("y")).unionByName(
            edges.select(F.col("lb").alias("x"), F.col("la").alias("y")))
        up = settle(ways.groupBy("x").agg(F.least("x", F.min("y")).alias("y")), "hooks")
        again = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
        twice = up.join(again, "y", "left").select("x", F.coalesce("z", "y").alias("to"))
        more = up.select(F.col("x").alias("to"), F.col("y").alias("z"))
        up = settle(twice.join(more, "to", "left").select("x", F.coalesce("z", "to").alias("to")), "hooks")
        labels = settle(labels.join(up, F.col("label") == F.col("x"), "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        l_up, r_up = up.select(F.col("x").alias("la"), F.col("to").alias("pa")), up.select(F.col("x").alias("lb"), F.col("to").alias("pb"))
        edges = settle(edges.join(l_up, "la").join(r_up, "lb").where("pa <> pb").select(
            F.col("pa").alias("la"), F.col("pb").alias("lb")).distinct(), "links")
    return labels


def residual_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components among candidates; enough of them to join all.

    ``members`` has area, node, label, sig, shingles: an area holds all nodes
    that could be linked with one another, a label is the component a node is
    in so far. An area of up to CHUNK nodes is one task's. In a larger one
    the nodes outside its largest component are compared with all, chunk by
    chunk, each pair of chunks in one task. A task compares full sets where
    the signatures allow a link and gives a link only where it joins two
    components it knows of, so it returns fewer rows than it has read. A pair
    at the threshold falls below the estimate with a chance under 1e-5.
    """
    per_label = members.groupBy("area", "label").agg(F.count(F.lit(1)).alias("n"))
    areas = per_label.groupBy("area").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("largest")).where(F.col("size") > F.col("largest.n"))
    rest = F.col("size") - F.col("largest.n")
    areas = areas.select(
        "area", F.col("largest.label").alias("most"), (F.col("size") <= CHUNK).alias("small"),
        F.ceil(F.col("largest.n") / CHUNK).alias("n_most"), F.ceil(rest / CHUNK).alias("n_rest"))
    rows = members.join(areas, "area").withColumn("outside", F.col("label") != F.col("most"))
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("n_rest")).otherwise(F.col("n_most")))
    rows = rows.withColumn("c", F.when(F.col("small"), 0).otherwise(chunk))
    zero, last = F.lit(0).cast("long"), F.col("n_most") + F.col("n_rest") - 1
    place = lambda i, k, left: F.struct(i.alias("i"), k.alias("k"), F.lit(left).alias("left"))
    against = F.transform(F.sequence(zero, last), lambda k: place(F.col("c"), k, True))
    as_rest = F.transform(F.sequence(zero, F.col("c")), lambda i: place(i, F.col("n_most") + F.col("c"), False))
    as_most = F.transform(F.sequence(zero, F.col("n_rest") - 1), lambda i: place(i, F.col("c"), False))
    where = F.when(F.col("small"), F.array(place(zero, zero, True))).when(
        F.col("outside"), F.concat(against, as_rest)).otherwise(as_most)
    tasks = rows.select("area", "small", "node", "label", "sig", "shingles", F.explode(where).alias("p")).select(
        "area", "p.i", "p.k", "p.left", "small", "node", "label", "sig", "shingles")
    least = max(1, SIGNATURE * percent // 100 - SLACK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["area", "i", "k"]):
            yield pd.DataFrame(_join_within(group, least, percent), columns=["a", "b"])

    return tasks.repartition("area", "i", "k").sortWithinPartitions("area", "i", "k", "node").mapInPandas(run, "a binary, b binary")


def _join_within(group: pd.DataFrame, least: int, percent: int) -> list[tuple]:
    """Links that join the components of one task's nodes."""
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, SIGNATURE)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    node, left = group["node"].tolist(), group["left"].to_numpy()
    size = np.array([len(x) for x in sets])
    part = pd.factorize(group["label"])[0].copy()
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.concatenate([[0], np.cumsum(size)])
    mask = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    both_sides = bool(group["small"].iloc[0])
    right = np.arange(len(node)) if both_sides else np.flatnonzero(~left)
    out = []
    for i in np.flatnonzero(left).tolist():
        other = right[(part[right] != part[i]) & ((right > i) if both_sides else True)]
        # Neither a set much smaller nor one much larger can be near enough.
        low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[100 * low >= percent * high]
        other = other[(sig[other] == sig[i]).sum(1) >= least]
        if not len(other):
            continue
        own = ids[cuts[i] : cuts[i + 1]]
        mask[own] = 1
        for a in range(0, len(other), 256):
            # What has been joined meanwhile needs no comparison any more.
            some = other[a : a + 256]
            some = some[part[some] != part[i]]
            if not len(some):
                continue
            flat = np.concatenate([ids[cuts[j] : cuts[j + 1]] for j in some.tolist()])
            both = np.add.reduceat(mask[flat], np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for j in some[100 * both >= percent * (size[i] + size[some] - both)].tolist():
                if part[j] != part[i]:
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    part[part == part[j]] = part[i]
        mask[own] = 0
    return out


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``keys``, across batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        own = frame[keys]
        new = (own != own.shift()).any(axis=1).to_numpy()
        new[0] = not held or tuple(held[-1][keys].iloc[-1]) != tuple(own.iloc[0])
        cuts = np.flatnonzero(new).tolist()
        if not cuts or cuts[0]:
            held.append(frame.iloc[: cuts[0] if cuts else len(frame)])
        for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=False):
            if held:
                yield pd.concat(held)
            held = [frame.iloc[a:b]]
    if held:
        yield pd.concat(held)


def cluster(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Texts are linked when their sets of ``k``-word shingles share at least
    ``percent`` of their union. ``component_id`` is the smallest id reachable
    by links, itself included; ``kept`` marks it. Equal sets are one node, so
    copies meet before any table. Null and empty texts have no shingles and
    are linked with nothing; a null id is linked like others, has no say in
    the smallest id and is kept only in a component without ids. Repeated
    rows each give a row, an empty table none. Other columns are not looked at.
    """
    with rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
        own = _labelled(docs, k, percent)
    least = own.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, F.col("label") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, label) of every row; rows of a component have the same label, null without shingles."""
    similarity = percent / 100
    base = settle(describe(docs, k), "shingle-sets")
    nodes = settle(base.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "set-nodes")
    buckets = band_keys(nodes, similarity).groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(band_keys(nodes, similarity).join(settle(buckets, "buckets").drop("n"), "band"), "shared-bands")
    stars = settle(shared.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    involved = shared.select("node").distinct()
    reps = nodes.join(involved, "node").select("node", "rep")
    # A repeated id may stand for other texts as well, so the set is named again.
    texts = settle(_texts_of(docs, reps, k), "candidate-texts")
    labels = settle(involved.select("node", F.col("node").alias("label")), "labels")
    whole = components(stars, labels)  # candidates, linked or not
    labels = components(verify(stars, texts, k, percent), labels)
    # A second round from the other end of the buckets that hold several components.
    marked = shared.join(labels, "node")
    ends = marked.groupBy("band").agg(
        F.max(F.struct("node", "label")).alias("end"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    again = marked.join(ends, "band").where(F.col("label") != F.col("end.label")).select(
        F.col("end.node").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(verify(settle(again, "stars"), texts, k, percent), labels)
    areas = labels.join(whole.withColumnRenamed("label", "area"), "node")
    mixed = areas.groupBy("area").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("area")
    mixed = settle(areas.join(mixed, "area", "left_semi").join(nodes.select("node", "sig"), "node"), "mixed-areas")
    sets = settle(_sets_of(texts.join(mixed.select("node"), "node", "left_semi"), k), "mixed-sets")
    labels = components(settle(residual_links(mixed.join(sets, "node"), percent), "residual-links"), labels)
    own = base.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return settle(own.select("doc_id", "n_shingles", "label"), "labelled")


def _texts_of(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(node, text) of the sets named in ``reps``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", TEXT_AT_ONCE):
            own = [set_key(s) for s in shingle_sets(frame["text"].tolist(), k)]
            yield frame.loc[[a == b for a, b in zip(own, frame["node"], strict=True)], ["node", "text"]]

    found = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")))
    rows = found.select("node", "text").mapInPandas(run, "node binary, text string")
    one = F.row_number().over(Window.partitionBy("node").orderBy(F.length("text"), "text"))
    return rows.withColumn("_no", one).where("_no = 1").drop("_no")


def _sets_of(texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the full set of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", TEXT_AT_ONCE):
            yield pd.DataFrame({"node": frame["node"], "shingles": [s.tobytes() for s in shingle_sets(frame["text"].tolist(), k)]})

    return texts.select("node", "text").mapInPandas(run, "node binary, shingles binary")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of the documents that stay.

    Rows that repeat an id are one document: they stay or go together.
    """
    gone = settle(cluster(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
