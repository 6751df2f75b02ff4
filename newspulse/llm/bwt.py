"""Repeated strings of a batch of texts from a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

SEPARATOR, PER_KEY = 257, 7


def leading(text: np.ndarray) -> np.ndarray:
    """The first PER_KEY symbols (each below 512) of every suffix as one number."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(PER_KEY, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(PER_KEY):
        key <<= 9
        key |= padded[j : j + n]
    return key


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first ``depth`` symbols, from their ``leading`` ones.

    A suffix is known by its place and those of the suffixes h and 2h symbols
    on: three times as many symbols a round where three places fit a number,
    else twice. Only suffixes that still share their place are sorted again.
    """
    n = len(key)
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    parts, h = (3 if n < 1 << 21 else 2), PER_KEY
    # Places count from 1; past the end, which sorts first, stands 0.
    rank, rows = np.zeros(n + 1, np.int64), np.arange(n)
    while h < depth:
        first = np.flatnonzero(new)
        size = np.diff(first, append=n)
        rank[order[rows]] = np.repeat(first + 1, size)[rows]
        rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(rows):
            break
        # In order of the text, which keeps what is looked up close together.
        open_place = np.zeros(n, bool)
        open_place[order[rows]] = True
        at = np.flatnonzero(open_place)
        key = rank[at]
        for k in range(1, parts):
            key *= n + 1
            key += rank[np.minimum(at + k * h, n)]
        again = np.argsort(key)
        order[rows] = at[again]
        ranked = key[again]
        new[rows[1:]] = ranked[1:] != ranked[:-1]
        h *= parts
    return order


def long_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, shared): shared[k] is true where the suffixes of rows k - 1
    and k have a common prefix of at least ``least`` symbols.

    The intervals of all strings are visited breadth-first, from the empty
    string, by extending each to the left by every symbol that precedes it.
    An interval of a string of length l + 1 whose right border is not settled
    yet settles it: the common prefix there has length l. Values come in
    increasing order, so after ``least`` levels the borders that are not
    settled are those of at least that value, and the expansion stops.
    The first levels, whose intervals hold most of the text, are read off the
    symbols that the order starts from.
    The text must end in a symbol that is smaller than all others and unique.
    """
    n = len(text)
    key = leading(text)
    order = suffix_order(key, least + 1)
    transform = text[order - 1]  # row of suffix 0 takes the last symbol
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    step[by_symbol] = np.arange(n)
    first = transform[by_symbol]
    open_border = np.ones(n + 1, dtype=bool)
    open_border[[0, n]] = False
    left, right = np.array([0]), np.array([n - 1])
    skipped = PER_KEY if least >= PER_KEY else 0
    if skipped:
        ranked = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        open_border[edge] = False
        # Intervals of strings of PER_KEY symbols that settle the common prefix of one symbol less.
        shorter = ranked >> 9
        same = np.concatenate([shorter[edge[1:-1] - 1] == shorter[edge[1:-1]], [False]])
        left, right = edge[:-1][same], edge[1:][same] - 1
    for _ in range(skipped, least):
        sizes = right - left + 1
        total = int(sizes.sum())
        if not total:
            break
        ids = np.repeat(np.arange(len(left)), sizes)
        rows = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
        if total * 8 > n:
            of_row = np.full(n, -1, np.int64)
            of_row[rows] = ids
            owner = of_row[by_symbol]
            at = np.flatnonzero(owner >= 0)
            owner = owner[at]
        else:
            at = step[rows]
            sort = np.argsort(at)
            at, owner = at[sort], ids[sort]
        symbol = first[at]
        starts = np.flatnonzero(np.concatenate([
            [True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1)]))
        lo, hi = at[starts], at[np.concatenate([starts[1:], [len(at)]]) - 1]
        fresh = open_border[hi + 1]
        left, right = lo[fresh], hi[fresh]
        open_border[right + 1] = False
    return order, open_border[:n]


def repeated_starts(regions: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For every region the starts of its strings of ``length`` bytes that occur elsewhere.

    A region of weight 2 or more stands for several places with these bytes;
    all its strings occur elsewhere.
    """
    sizes = np.array([len(r) for r in regions])
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends - 1] = SEPARATOR
    text = np.concatenate([text, np.zeros(1, np.uint16)])
    order, shared = long_prefixes(text, length)
    hit = np.zeros(len(text), dtype=bool)
    rows = np.flatnonzero(shared)
    hit[order[rows]] = True
    hit[order[rows - 1]] = True
    out = []
    for a, n, w in zip(begin.tolist(), sizes.tolist(), weights.tolist(), strict=True):
        count = max(0, n - length + 1)
        out.append(np.arange(count) if w > 1 else np.flatnonzero(hit[a : a + count]))
    return out
