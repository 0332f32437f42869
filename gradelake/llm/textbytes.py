"""Vectorised byte-level helpers shared by the text operators.

Everything here works on one Arrow batch inside a Spark task.  Texts stay in
their Arrow buffer: a batch is viewed as one ``uint8`` array plus row offsets, so
no Python object is made per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time by the numpy kernels (each needs ~60 bytes of scratch a byte).
CHUNK = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random value for each byte and an odd multiplier: a polynomial hash modulo 2**64.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads a polynomial hash over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def by_bytes(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Rolling:
    """Hashes of any substring of ``raw`` in constant time each."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        cls = Rolling
        if len(cls._powers) < n + 1:
            size = max(n + 1, CHUNK + 4096)
            for name, base in (("_powers", _BASE), ("_inverse", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * cls._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of ``raw[start:end]`` for arrays of positions."""
        return mix((self.sums[end] - self.sums[start]) * Rolling._inverse[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of one length, by start."""
        m = len(self.sums) - length
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:m]) * Rolling._inverse[:m] + np.uint64(length))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """``min(x[i:i+w])`` for every i, by block-wise running minima from both sides."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    p = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    p[:n] = x
    p = p.reshape(blocks, w)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])
