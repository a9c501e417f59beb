"""Vectorised word and window hashing over Arrow string columns.

An Arrow string column is one byte buffer plus offsets.  The helpers below cut
it into slices of bounded bytes (a single longer text is a slice of its own)
and find words and hash them with prefix sums, so the cost is a few numpy
passes per byte and no Python object is made per word.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere here.  A null text has no words.
Hashes are 64-bit polynomials modulo 2**64 with an avalanche step at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD1342543DE82EF95
WINDOW_BASE_2 = 0xC2B2AE3D27D4EB4F

_NONSPACE = np.ones(256, dtype=bool)
_NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**t, base**-t) modulo 2**64 for t < n; cached, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())

        def run(b: int) -> np.ndarray:
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            return np.cumprod(a)
        have = _powers[base] = (run(base), run(pow(base, -1, 1 << 64)))
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of every ``values[lo:hi]``, in O(1) each after one prefix sum."""
    up, down = powers(base, len(values) + 1)
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=run[1:])
    return mix((run[hi] - run[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(_BYTE_BASE))


class Words(NamedTuple):
    """Words of a slice of rows."""
    data: np.ndarray     # bytes of the slice (lower-cased on request)
    lo: np.ndarray       # first byte of each word
    hi: np.ndarray       # byte behind each word
    first: np.ndarray    # index of each row's first word; one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.lo, self.hi, _BYTE_BASE)


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row behind the last, bytes, offsets) of bounded slices."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def find_words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    word = _NONSPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    lo = np.flatnonzero(starts)
    return Words(data, lo, np.flatnonzero(ends) + 1, np.searchsorted(lo, offs))


def windows(words: Words, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, row) of every window of q words inside one row."""
    row = words.row
    n = len(row) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[q - 1:])
    return at, row[at]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
