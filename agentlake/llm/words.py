"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

Words are runs of bytes other than ASCII white space. A hash is the sum of random values of
the bytes times powers of an odd multiplier, taken from running sums over the text, and
then mixed. Two given words share one with a probability near 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from agentlake.llm.common import text_bytes

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed in one go.
RUN = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a string column: ``hashes``, byte positions ``starts`` and ``ends``, ``counts`` per row."""

    def __init__(self, texts: pa.Array, lower: bool = False, alphabet: np.ndarray = _IS_WORD):
        data, offsets = text_bytes(texts)
        self.data = _LOWER[data] if lower else data
        inside = alphabet[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        borders = offsets[offsets < len(data)]
        before[borders] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.counts = np.searchsorted(self.starts, offsets[1:]) - self.first
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first, self.counts)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, base + RUN, side="right")))
            last = self.ends[stop - 1]
            n = int(last - base)
            if not _tables or len(_tables[0]) <= n:
                _tables[:] = [_powers(_BASE, max(n, RUN) + 1), _powers(_INVERSE, max(n, RUN) + 1)]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[self.data[base:last]] * _tables[0][:n], out=sums[1:])
            s, e = self.starts[at:stop] - base, self.ends[at:stop] - base
            out[at:stop] = (sums[e] - sums[s]) * _tables[1][s] + (e - s).astype(np.uint64)
            at = stop
        return mix(out)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words within a row, and the index of their first word."""
        size = len(self.hashes) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                total += mix(self.hashes[k : k + size] + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))
        whole = np.flatnonzero(self.place[:size] + n <= self.counts[self.rows[:size]])
        return mix(total[whole]), whole
