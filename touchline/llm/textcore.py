"""Vectorised byte-level text primitives shared by the operators.

Texts reach Python as Arrow string columns. Their UTF-8 buffer is viewed as one
numpy array and all documents of a chunk are handled together, so the cost per
byte is a few numpy passes and no Python object is made per word.

Hashes are polynomial prefix sums modulo 2**64 over random byte values; the
hash of any slice comes from two prefix sums. A finaliser mixes the bits, since
the low bits of such sums are weak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

# The white space of the word pattern [^\x20\x09-\x0D]+ (fixed values).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, dtype=np.uint64)) | 1


class Poly:
    """Polynomial hashing with one odd multiplier; power tables grow on demand."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed + 1).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.r = _odd(seed) * 4 + 1 & (1 << 64) - 1 | 5
        self.inv = pow(self.r, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.r, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inv, m, 1 << 64))])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[j] * r**j, with a leading zero."""
        n = len(values)
        self.powers(n + 1)
        out = np.zeros(n + 1, U)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.values[data])

    def slices(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mixed hash of each [lo, hi)."""
        return mix((prefix[hi] - prefix[lo]) * self.down[lo])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows: (first row, end row, bytes, offsets from 0). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start, end = solid.copy(), solid
    start[1:] &= ~solid[:-1] | edge[1:-1]
    lo = np.flatnonzero(start)
    last = end.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    hi = np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(offs, lo, "right") - 1


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated lo[i] .. lo[i]+n[i]-1."""
    n = np.asarray(n, np.int64)
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) - np.repeat(end - n - lo, n)
