"""Hashes of all substrings of a byte buffer from one running sum."""

from __future__ import annotations

import numpy as np

from newspulse.llm.common import mix64

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


_held: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both, at least ``n``; the longest asked for so far serve all shorter buffers."""
    if n <= len(_held[0]):
        return _held
    out = []
    for r in (BASE, INVERSE):
        p = np.empty(n, np.uint64)
        p[0] = 1
        k = 1
        while k < n:  # doubling: the second half is the first times r**k
            m = min(k, n - k)
            p[k : k + m] = p[:m] * np.uint64(pow(r, k, 1 << 64))
            k += m
        out.append(p)
    _held[:] = out
    return _held


class Rolling:
    """Hash of ``data[a:b]`` for arrays of a and b, whatever its place in the buffer."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        # Bytes are scrambled first, so that small differences don't cancel out.
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` bytes."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a])


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
