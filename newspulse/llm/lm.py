"""Log-probabilities of texts under a small causal self-attention model.

Words become subword ids of a public byte-level vocabulary. One attention
layer reads the ids before a position inside a context window; its output
gives a distribution over classes of ids and one over the members of a class.
Ids too rare for a row of their own share the last one by their counts over the
training texts. Windows overlap by half: the first half
is context only, so every token is scored once, with at least HALF tokens of
context where the text has them. The weights are trained by rounds of local
gradient steps whose results are averaged.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.llm.common import held_out, slices, words_of
from newspulse.session import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256  # the id that the vocabulary leaves free
IDS = END + 1
CLASSES, MEMBERS, DIM = 64, 32, 16  # output classes; their members; width of an embedding
ROWS = CLASSES * MEMBERS  # frequent ids with an embedding each; the last one is for all others
HALF = 8
KNOWN_WORDS, LONG_WORD = 300_000, 256  # words a task remembers; bytes beyond which a word is cut
FIRST, PAD = ROWS, ROWS + 1  # rows of the start of a text and of the space before it
ROUNDS, BATCH, RATE = 6, 128, 0.03
CONTEXTS, SHRINK = 256, 80  # rows whose followers are counted apart; counts that a share of followers is drawn to the mean by
IDS_AT_ONCE = 1_000_000  # bytes of ids a task makes windows of at a time
FREQUENT = 200_000  # words whose counts every task holds; the others are joined
WORDS_AT_ONCE = 300_000  # distinct words a task counts before it sends them on


class Tokenizer:
    """Subword ids of lower-cased words, each led by a blank; long words in pieces."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        # Words have no blank inside, so each is one piece and starts with the only blank in it; later pieces of a long word have none.
        self.encode = tiktoken.Encoding("subwords", pat_str=" ?[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leads = np.zeros(IDS, bool)
        self.leads[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        self.known: dict[bytes, bytes] = {}

    def learn(self, counts: dict[bytes, int]) -> None:
        """Make the words of ``counts`` known, all new ones in one call."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {w: self.known[w] for w, n in counts.items() if n > 1 and w in self.known}
        new = [w for w in counts if w not in self.known]
        short = [w for w in new if len(w) <= LONG_WORD]
        if short:
            ids = np.array(self.encode(" " + b" ".join(short).decode("utf-8", "replace")), np.uint16)
            raw = ids.tobytes()
            at = (2 * np.flatnonzero(self.leads[ids])).tolist()
            self.known.update(zip(short, (raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        for w in new:
            if len(w) > LONG_WORD:
                text = w.decode("utf-8", "replace")
                ids = [i for a in range(0, len(text), LONG_WORD) for i in self.encode(" " * (a == 0) + text[a : a + LONG_WORD])]
                self.known[w] = np.array(ids, np.uint16).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of a text of known words, END last."""
        raw = b"".join(map(self.known.__getitem__, words))
        return np.concatenate([np.frombuffer(raw, np.uint16), np.array([END], np.uint16)])


class Weights(NamedTuple):
    emb: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Weights:
        cuts = np.cumsum([x.size for x in self])[:-1]
        return Weights(*(p.reshape(x.shape) for p, x in zip(np.split(flat, cuts), self, strict=True)))


class Vocabulary(NamedTuple):
    """By id: its embedding row, its place among the members of all classes, and log10 of its share of that."""

    row: np.ndarray
    slot: np.ndarray
    share: np.ndarray


def windows_of(ids: np.ndarray) -> np.ndarray:
    """(2 * HALF + HALF, windows): inputs, the last HALF of which are asked, and their targets.

    Inputs are the ids before each target, led by the start of the text;
    -1 is the space before it and after the end.
    """
    n = -(-len(ids) // HALF)
    inputs = np.full((n + 1) * HALF, -1, np.int32)
    inputs[HALF] = -2  # the start
    inputs[HALF + 1 : HALF + len(ids)] = ids[:-1]
    targets = np.full(n * HALF, -1, np.int32)
    targets[: len(ids)] = ids
    halves = inputs.reshape(n + 1, HALF)
    return np.concatenate([halves[:-1], halves[1:], targets.reshape(n, HALF)], axis=1).T


def _rows(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.concatenate([row, np.array([FIRST, PAD], row.dtype)])[ids]  # -2 is the start, -1 the space


def _softened(z: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """``z`` plus ``mask``, in place, shifted by row if its exponentials could leave their range."""
    far = z.size and not -60 < z.min() <= z.max() < 60
    if mask is not None:
        z += mask
    if far:
        z -= z.max(-1, keepdims=True)
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[-1], z.dtype)


class Tables(NamedTuple):
    """What the attention reads of every row, and by how much a position sees another."""

    asked: np.ndarray  # embedding and query
    read: np.ndarray  # key and value
    near: np.ndarray  # (HALF, 2 * HALF); what stands after a position is masked


def _before() -> np.ndarray:
    """(HALF, 2 * HALF): how far each position stands before an asked one."""
    return HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)


def tables_of(w: Weights) -> Tables:
    far = _before()
    query = w.query / np.sqrt(DIM).astype(w.query.dtype)
    return Tables(
        np.concatenate([w.emb, w.emb @ query], axis=1), w.emb @ np.concatenate([w.key, w.value], axis=1),
        np.where(far >= 0, w.near[far], w.near.dtype.type(-1e9)))


def states(tables: Tables, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """State after each asked input (windows, HALF, DIM), and the rows, queries, keys, values and attention behind it.

    ``rows`` is (2 * HALF, windows). Attention is masked: a position sees
    itself and what stands before it, never the space before the text.
    """
    at = np.ascontiguousarray(rows.T)
    asked, read = np.take(tables.asked, at[:, HALF:], axis=0), np.take(tables.read, at, axis=0)
    own, q, k, v = asked[..., :DIM], asked[..., DIM:], read[..., :DIM], read[..., DIM:]
    s = np.matmul(q, k.transpose(0, 2, 1))
    mask = np.where(at == PAD, s.dtype.type(-1e9), s.dtype.type(0))[:, None] + tables.near
    np.exp(_softened(s, mask), out=s)
    s /= _sums(s)[..., None]
    return np.matmul(s, v) + own, at, q, k, v, s


def forward(w: Weights, rows: np.ndarray) -> tuple:
    """Class log-probabilities (HALF, CLASSES, windows) after each asked input."""
    z = _softened(states(tables_of(w), rows)[0] @ w.out + w.bias)
    z -= np.log(_sums(np.exp(z)))[..., None]
    return (z.transpose(1, 2, 0),)


def _chosen(z: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of ``z``, in place, their sums, and the log-probability of the wanted one."""
    logit = _softened(z)[np.arange(len(z)), wanted]
    whole = _sums(np.exp(z, out=z))
    return whole, logit - np.log(whole)


def _members(w: Weights, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """States sorted by class, the order, (from, to, members) of each class that occurs, and the members' logits.

    Members of a class together: one product for all that want it.
    """
    order = np.argsort(c.astype(np.uint8 if CLASSES <= 256 else np.uint16), kind="stable")
    sorted_c, sorted_h = c[order], np.take(h, order, axis=0)
    cuts = np.searchsorted(sorted_c, np.arange(CLASSES + 1)).tolist()
    parts = [(a, b, slice(k * MEMBERS, (k + 1) * MEMBERS)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    z, turned = np.empty((len(c), MEMBERS), h.dtype), np.ascontiguousarray(w.member.T)
    for a, b, own in parts:
        np.matmul(sorted_h[a:b], turned[:, own], out=z[a:b])
    z += np.take(w.member_bias.reshape(CLASSES, MEMBERS), sorted_c, axis=0)
    return sorted_h, order, parts, z


def gradient(w: Weights, rows: np.ndarray, slots: np.ndarray) -> tuple[Weights, float]:
    """Gradient of the mean negative log-probability of ``slots`` (HALF, windows; -1: none)."""
    state, at, q, k, v, s = states(tables_of(w), rows)
    slots = slots.T.ravel()
    valid = slots >= 0
    count, (c, m) = max(1, int(valid.sum())), divmod(np.maximum(slots, 0), MEMBERS)
    share, h, each = valid.astype(np.float32) / np.float32(count), state.reshape(-1, DIM), np.arange(len(slots))
    z = h @ w.out
    z += w.bias
    whole, logp = _chosen(z, c)
    loss = -float((logp * valid).sum())
    z *= (share / whole)[:, None]
    z[each, c] -= share
    d_out, d_bias, dh = h.T @ z, np.ones(len(z), z.dtype) @ z, z @ w.out.T
    h, order, parts, z = _members(w, h, c)
    wanted, weight = m[order], share[order]
    whole, logp = _chosen(z, wanted)
    loss -= float((logp * valid[order]).sum())
    z *= (weight / whole)[:, None]
    z[each, wanted] -= weight
    d_both, inner = np.zeros((ROWS, DIM + 1), h.dtype), np.empty_like(h)
    turned, with_one = np.ascontiguousarray(z.T), np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
    for a, b, own in parts:
        np.matmul(turned[:, a:b], with_one[a:b], out=d_both[own])
        np.matmul(z[a:b], w.member[own], out=inner[a:b])
    d_member, d_mbias = d_both[:, :DIM], d_both[:, DIM]
    dh[order] += inner
    dh = dh.reshape(-1, HALF, DIM)
    ds = np.matmul(dh, v.transpose(0, 2, 1))
    ds -= _sums(s * ds)[..., None]
    ds *= s
    dq = np.matmul(ds, k).reshape(-1, DIM) / np.sqrt(DIM).astype(np.float32)
    d_read = np.concatenate([np.matmul(ds.transpose(0, 2, 1), q), np.matmul(s.transpose(0, 2, 1), dh)], axis=2).reshape(-1, 2 * DIM)
    far, x = _before(), np.take(w.emb, at, axis=0)
    d_near = np.bincount(far[far >= 0], ds.sum(0)[far >= 0], 2 * HALF).astype(w.near.dtype)
    dx = (d_read @ np.concatenate([w.key, w.value], axis=1).T).reshape(-1, 2 * HALF, DIM)
    dx[:, HALF:] += dh + (dq @ w.query.T).reshape(dh.shape)
    cells = (at.astype(np.int64) * DIM)[..., None] + np.arange(DIM)
    d_emb = np.bincount(cells.ravel(), dx.ravel(), w.emb.size).astype(w.emb.dtype).reshape(w.emb.shape)
    d_query, d_read = x[:, HALF:].reshape(-1, DIM).T @ dq, x.reshape(-1, DIM).T @ d_read
    d_key, d_value = d_read[:, :DIM], d_read[:, DIM:]
    return Weights(d_emb, d_query, d_key, d_value, d_near, d_out, d_bias, d_member, d_mbias), loss / count


def local_steps(w: Weights, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> Weights:
    """The weights after one step with adaptive rates for each batch."""
    flat = w.flat()
    mean, square, part = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    for t, (rows, slots) in enumerate(batches, 1):
        g = gradient(w.like(flat), rows, slots)[0].flat()
        mean *= 0.9
        mean += np.multiply(g, 0.1, out=part)
        square *= 0.99
        g *= g
        square += np.multiply(g, 0.01, out=part)
        np.sqrt(square, out=part)
        part += 1e-7 * (1 - 0.99**t) ** 0.5
        np.divide(mean, part, out=part)
        part *= rate * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        flat -= part
    return w.like(flat)


GATHERED = "kind int, key long, word binary, n long, ids binary"
ID, WORD, WINDOWS, TEXTS = range(4)


def gather(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """One pass over the training texts: counts of ids and words, ids to train on.

    Kinds: ID (key, n), WORD (word, n), WINDOWS (all ids of one text and
    the number of its windows, key a number drawn from the text), TEXTS (n). Counts are per task.
    """
    spread = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, ids_seen, words, texts = Tokenizer(spread.value), np.zeros(IDS, np.int64), Counter(), 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"kind": WORD, "key": 0, "word": list(words), "n": list(words.values()), "ids": None})
            words.clear()
            return out

        for frame in slices(frames, "text", 2_000_000):
            rows, every = [], [words_of(t) for t in frame["text"]]
            counts = Counter(chain.from_iterable(every))
            words.update(counts)
            tokenizer.learn(counts)
            texts += len(every)
            for own in every:
                ids = tokenizer.ids(own)
                ids_seen += np.bincount(ids, minlength=IDS)
                held = ids.astype(np.uint16).tobytes()
                rows.append((WINDOWS, zlib.crc32(held), None, -(-len(ids) // HALF), held))
            yield pd.DataFrame(rows, columns=["kind", "key", "word", "n", "ids"])
            if len(words) > WORDS_AT_ONCE:
                yield flush()
        yield flush()
        at = np.flatnonzero(ids_seen)
        yield pd.DataFrame({"kind": ID, "key": at, "word": None, "n": ids_seen[at], "ids": None})
        yield pd.DataFrame({"kind": [TEXTS], "key": [0], "word": [None], "n": [texts], "ids": [None]})

    return settle(docs.select("text").mapInPandas(run, GATHERED), "lm-gathered")


def _matrix(raw) -> np.ndarray:
    """All windows of some texts as one (3 * HALF, windows) array."""
    parts = [windows_of(np.frombuffer(r, np.uint16)) for r in raw]
    return np.concatenate(parts, axis=1) if parts else np.empty((3 * HALF, 0), np.int32)


def rows_by_count(counts: np.ndarray) -> np.ndarray:
    """Embedding row of every id: the frequent ones their own, all others the last."""
    row = np.full(IDS, ROWS - 1, np.int32)
    order = np.lexsort((np.arange(IDS), -counts))[: ROWS - 1]
    row[order] = np.arange(len(order))
    return row


def slots_of_rows(before: np.ndarray) -> np.ndarray:
    """Place of every row in classes of equal size, by what stands before it.

    ``before`` has the counts (ROWS, contexts). Rows are halved again and again
    at the median of the direction in which their contexts differ most.
    """
    p = np.sqrt(before / np.maximum(before.sum(1, keepdims=True), 1))
    parts = [np.arange(ROWS)]
    while len(parts) < CLASSES:
        halves = []
        for part in parts:
            own = p[part] - p[part].mean(0)
            along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
            order = part[np.lexsort((part, along))]
            halves += [np.sort(h) for h in np.split(order, 2)]
        parts = halves
    slot = np.empty(ROWS, np.int64)
    slot[np.concatenate(parts)] = np.arange(ROWS)
    return slot


def counted_start(w: Weights, before: np.ndarray, whole: np.ndarray) -> Weights:
    """``w`` with embeddings and outputs that tell a token from the one before it.

    ``before`` has the counts (places, contexts). The log-ratios of a context's
    classes, and members inside them, to those of all tokens are cut to DIM
    dimensions by a singular value decomposition. Values start at zero, so
    that attention adds to this what training finds.
    """
    n = before.sum(0)
    if not n.any():
        return w
    by_class, classes = before.reshape(CLASSES, MEMBERS, -1).sum(1), whole.reshape(CLASSES, MEMBERS).sum(1)
    of_class, of_member = (classes / classes.sum())[:, None], (whole / np.repeat(classes, MEMBERS))[:, None]
    ratio = lambda c, all_c, p: np.log((c + SHRINK * p) / (all_c + SHRINK) / p)
    ratios = np.concatenate([ratio(by_class, n, of_class), ratio(before, np.repeat(by_class, MEMBERS, axis=0), of_member)])
    weight = np.sqrt(np.concatenate([classes, whole]) / classes.sum())[:, None]
    share = np.sqrt(n / n.sum())
    left, size, right = np.linalg.svd(ratios * weight * share, full_matrices=False)
    left, size, right = left[:, :DIM], size[:DIM], right[:DIM]
    scale = max(1e-6, float(np.sqrt((size**2).sum() / DIM)))  # embeddings have length 1 a dimension
    emb = (right / np.maximum(share, 1e-9)).T * size / scale
    out = left / weight * scale
    emb = emb[np.minimum(np.arange(ROWS + 2), len(n) - 1)]
    f = lambda x: np.ascontiguousarray(x, np.float32)
    return w._replace(emb=f(emb), out=f(out[:CLASSES].T), member=f(out[CLASSES:]), value=np.zeros_like(w.value))


def fit(gathered: DataFrame, seed: int = 0) -> tuple[Weights, Vocabulary]:
    """Weights and vocabulary from what ``gather`` brought.

    Every window trains the weights once, in a corpus of any size.

    The driver sees sums over all tasks only: counts per id, counts per pair
    of frequent rows, and averaged weights in blocks.
    """
    sc, counts = gathered.sparkSession.sparkContext, np.zeros(IDS, np.int64)
    for r in gathered.where(F.col("kind") == ID).groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[r.key] = r.n
    row = rows_by_count(counts)
    windows = gathered.where((F.col("kind") == WINDOWS) & (F.col("n") > 0)).select("key", "n", "ids")
    contexts, row_b = CONTEXTS, sc.broadcast(row)

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, row = np.zeros(ROWS * contexts, np.int64), row_b.value
        for frame in slices(frames, "ids", IDS_AT_ONCE):
            m = _matrix(frame["ids"])
            a, b = m[HALF : 2 * HALF].ravel(), m[2 * HALF :].ravel()
            a, b = np.minimum(_rows(a[b >= 0], row), contexts - 1), row[b[b >= 0]]
            seen += np.bincount(b * contexts + a, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": at, "n": seen[at]})

    before = np.zeros(ROWS * contexts)
    for r in windows.mapInPandas(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        before[r.cell] = r.n
    before = before.reshape(ROWS, contexts)
    place = slots_of_rows(before)
    slot = place[row]
    mass = counts + 0.1
    whole = np.bincount(slot, mass, ROWS)
    vocabulary = Vocabulary(row, slot, np.log10(mass / whole[slot]))
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    classes = whole.reshape(CLASSES, MEMBERS).sum(1)
    log = lambda x: np.log(x).astype(np.float32)
    w = Weights(
        draw(ROWS + 2, DIM), draw(DIM, DIM), draw(DIM, DIM), draw(DIM, DIM), np.zeros(2 * HALF, np.float32), draw(DIM, CLASSES),
        log(classes / classes.sum()), draw(ROWS, DIM), log(np.maximum(whole, 1e-3) / np.repeat(classes, MEMBERS)))
    w = counted_start(w, before[np.argsort(place)], whole)
    for r in range(ROUNDS):
        w = _round(windows.where(F.pmod("key", F.lit(ROUNDS)) == r), w, row, slot, RATE * (1 - r / ROUNDS))
    return w, vocabulary


def _round(windows: DataFrame, w: Weights, row: np.ndarray, slot: np.ndarray, rate: float) -> Weights:
    """Local steps in every task, then the mean of their weights by windows."""
    held = windows.sparkSession.sparkContext.broadcast((w, row, slot))
    blocks = 16

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, row, slot = held.value
        seen = 0
        for frame in slices(frames, "ids", IDS_AT_ONCE):
            m = _matrix(frame["ids"])
            rows, target = _rows(m[: 2 * HALF], row), m[2 * HALF :]
            slots = np.where(target >= 0, slot[target], -1)
            seen += m.shape[1]
            w = local_steps(w, [(rows[:, a : a + BATCH], slots[:, a : a + BATCH]) for a in range(0, m.shape[1], BATCH)], rate)
        if seen:
            parts = np.array_split(w.flat().astype(np.float64) * seen, blocks)
            yield pd.DataFrame({"block": range(blocks), "seen": seen, "v": [p.tobytes() for p in parts]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, np.float64) for x in frame["v"]) / frame["seen"].sum()
        return pd.DataFrame({"block": frame["block"].iloc[:1], "v": [v.tobytes()]})

    means = windows.mapInPandas(steps, "block int, seen long, v binary").groupBy("block").applyInPandas(total, "block int, v binary")
    got = sorted((r.block, r.v) for r in means.collect())
    return w.like(np.concatenate([np.frombuffer(v) for _, v in got]).astype(np.float32)) if got else w


class Scorer:
    """Log-probabilities of targets for fixed weights."""

    def __init__(self, w: Weights, v: Vocabulary, width: int = 512):
        self.w, self.v, self.width, self.tables = w, v, width, tables_of(w)

    def slots(self, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Log-probabilities of ``slots`` (HALF, windows): of their classes, and inside them."""
        h, (c, m) = states(self.tables, rows)[0].reshape(-1, DIM), divmod(slots.T.ravel(), MEMBERS)
        z = h @ self.w.out
        z += self.w.bias
        out = _chosen(z, c)[1]
        _, order, _, z = _members(self.w, h, c)
        out[order] += _chosen(z, m[order])[1]
        return out.reshape(-1, HALF).T

    def log10(self, windows: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """log10 probability of each text from its windows (3 * HALF, n)."""
        out = np.zeros(texts)
        for a in range(0, windows.shape[1], self.width):
            m, own = windows[:, a : a + self.width], owner[a : a + self.width]
            target = m[2 * HALF :]
            p = self.slots(_rows(m[: 2 * HALF], self.v.row), self.v.slot[target]) / np.log(10) + self.v.share[target]
            out += np.bincount(own, (p * (target >= 0)).sum(0), texts)
        return out


def frequent_words(words: DataFrame) -> dict[bytes, int]:
    """Counts of the most frequent words, at most FREQUENT of them.

    Words come by steps of their count's logarithm, as many whole steps as
    fit, so only these words and some hundred sums reach the driver.
    """
    step = F.floor(F.log("c") * 16)
    sizes = words.where("c > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r.n
        if total > FREQUENT:
            break
        least = r.step
    if least is None:
        return {}
    return {bytes(r.word): r.c for r in words.where("c > 0").where(step >= least).collect()}


SCORED = ("doc_id long, held_out boolean, n_tokens long, known long, part double, rest long, score double, "
          "rare array<struct<word:binary,n:long>>")


def score(docs: DataFrame, modulus: int = 10, rest: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the text's words and end;
    ``base_score`` that of smoothed counts of whole words. Everything is
    learned from the rows that are not held out. Counts of the most frequent
    words, FREQUENT at most, are with every task; a text's other words meet theirs in a
    join. Null counts as empty (one token, the end); repeated rows each give a
    row; an empty table gives none. Without any training text all counts are
    zero and the weights stay as drawn. Other columns are not looked at.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    with open(vocabulary, "rb") as f:
        raw = f.read()  # of the driver; the tasks get it by broadcast
    rows = docs.select("doc_id", "text", held_out("doc_id", modulus, rest).alias("held_out"))
    gathered = gather(rows.where(~F.col("held_out")), raw)
    w, v = fit(gathered)
    words = settle(gathered.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    texts = gathered.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = tokens + texts, distinct + (texts > 0)
    frequent = frequent_words(words)
    held = sc.broadcast((raw, w, v, frequent, texts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, w, v, frequent, texts = held.value
        tokenizer, log = Tokenizer(raw), {k: float(np.log10(c + 0.1)) for k, c in frequent.items()}
        scorer, end = Scorer(w, v), float(np.log10(texts + 0.1))
        for frame in slices(frames, "text", 500_000):
            windows, out, every = [], [], [words_of(t) for t in frame["text"]]
            tokenizer.learn(Counter(chain.from_iterable(every)))
            for doc_id, own, is_out in zip(frame["doc_id"], every, frame["held_out"], strict=True):
                windows.append(windows_of(tokenizer.ids(own)))
                p = np.fromiter(map(log.get, own, repeat(np.nan)), np.float64, len(own))
                others = np.flatnonzero(np.isnan(p)).tolist()
                rare = [{"word": x, "n": n} for x, n in Counter(map(own.__getitem__, others)).items()]
                known, part = len(own) - len(others) + int(texts > 0), end + float(np.nansum(p))
                out.append((doc_id, is_out, len(own) + 1, known, part, len(others), rare))
            result = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "known", "part", "rest", "rare"])
            owner = np.repeat(np.arange(len(out)), [x.shape[1] for x in windows])
            result["score"] = scorer.log10(np.concatenate(windows, axis=1), owner, len(out)) if out else []
            result["doc_id"] = result["doc_id"].astype("Int64")
            yield result[[c.split()[0] for c in SCORED.split(", ")]]

    # Numbered when written, so that rows that repeat an id stay apart.
    scored = settle(rows.mapInPandas(run, SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(words, "word").groupBy("row").agg(
        F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("rare_part"))
    all_log = float(np.log10(tokens + 0.1 * (distinct + 1)))
    found = F.coalesce("rare_known", F.lit(0))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + found).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare_part", F.lit(0.0)) + (F.col("rest") - found) * F.log10(F.lit(0.1))
         - F.col("n_tokens") * F.lit(all_log)).alias("base_score"), "score")
