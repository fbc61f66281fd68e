"""Words and byte n-grams of whole Arrow string columns, in numpy, without a Python object for each word.

Hashes are 64-bit, the same in every task; bytes are lower-cased for A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing, on UTF-8 bytes
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: [^\x20\x09-\x0D] on UTF-8 bytes
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUE = mix((LOWER.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` text bytes each (one row at least)."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield batch.slice(k, end - k)
        k = end


def words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each row's words), words being the maximal runs of ``kind`` bytes."""
    raw, at = buffers(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    is_word = kind[raw]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    begin, end = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
    first[begin] |= is_word[begin]
    last[end] |= is_word[end]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        e = max(k + 1, int(np.searchsorted(stop, start[k] + _CHUNK, "right")))
        lo, hi = int(start[k]), int(stop[e - 1])
        up, down = _power(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[raw[lo:hi]] * up, out=total[1:])
        s, t = start[k:e] - lo, stop[k:e] - lo
        out[k:e] = (total[t] - total[s]) * down[s] + (t - s).astype(np.uint64) * U(0xA24BAED4963EE407)
        k = e
    return mix(out), np.searchsorted(start, at).astype(np.int64)


def follow(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its first n-1 words and its last."""
    return mix(keys * U(0x9FB21C651E98DF25) + more)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs (or the sum of its weights)."""
    if weights is None:
        return np.unique(values, return_counts=True)
    key, at = np.unique(values, return_inverse=True)
    return key, np.bincount(at, weights, len(key)).astype(np.int64)


class Counts:
    """Running counts of keys whose memory stays at a few times ``limit`` keys: full ones are handed out to be summed by Spark."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            k, c = counted(keys)
            self.parts.append((k, c.astype(np.int64)))
            self.n += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = counted(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        self.parts, self.n = [(k, c)], len(k)
        return k, c

    def full(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Merge when over the limit; hand the counts out when merging alone doesn't help."""
        if self.n < self.limit:
            return None
        k, c = self.merged()
        if len(k) < self.limit // 2:
            return None
        self.parts, self.n = [], 0
        return k, c
