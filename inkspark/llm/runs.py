"""Runs of bytes in whole Arrow string columns: where words begin and end, their polynomial fingerprints, and filters over fingerprints of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import shuffles_cleared
from inkspark.llm.textvec import U, mix

_BASE = 0xC2B2AE3D27D4EB4F  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 17
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, _CHUNK + 1), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


def spans(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of the maximal runs of true bytes that don't cross the row limits ``at``."""
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    begin, end = at[:-1][at[:-1] < len(is_word)], at[1:][at[1:] > 0] - 1
    first[begin] |= is_word[begin]
    last[end] |= is_word[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rabin-Karp fingerprints of the ascending spans of a sequence of 64-bit values: differences of its prefix polynomials, brought to the power 0."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        e = max(k + 1, int(np.searchsorted(stop, start[k] + _CHUNK, "right")))
        lo, hi = int(start[k]), int(stop[e - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[lo:hi] * powers(_BASE, hi - lo), out=total[1:])
        s, t = start[k:e] - lo, stop[k:e] - lo
        out[k:e] = (total[t] - total[s]) * powers(_INVERSE, hi - lo + 1)[s]
        k = e
    return out


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix(prefix_hashes(_VALUE[raw], start, stop) + (stop - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column of consecutive pieces of ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def gathered(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans one after another."""
    before = np.cumsum(lengths) - lengths
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.repeat((start - before).astype(kind), lengths)
    at += np.arange(len(at), dtype=kind)
    return data[at]


class Sieve:
    """A Bloom filter of fixed size over 64-bit keys: it never loses a key; what it lets through besides only adds rows to a later count."""

    HASHES = 3

    def __init__(self, words: np.ndarray, drop: int = 0):
        self.words, self.shift, self.drop = words, U(64 - (len(words) * 64).bit_length() + 1), U(drop)

    @staticmethod
    def places(keys: np.ndarray, shift: np.uint64) -> Iterator[np.ndarray]:
        for salt in range(1, Sieve.HASHES + 1):
            yield mix(keys + U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> shift

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys >> self.drop, self.shift):
            out &= (self.words[(p >> U(6)).astype(np.int64)] >> (p & U(63)) & U(1)).astype(bool)
        return out

    @classmethod
    def of(cls, keys: DataFrame, column: str, log_bits: int = 27, drop: int = 0) -> Sieve:
        """Of keys without their last ``drop`` bits. Built by Spark: tasks set bits, words of bits are united by a shuffle; at most 2**(log_bits - 6) of them reach the driver, however many keys there are."""
        shift = U(64 - log_bits)

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                p = np.unique(np.concatenate(list(cls.places(k, shift))))
                at, first = np.unique(p >> U(6), return_index=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.bitwise_or.reduceat(U(1) << (p & U(63)), first).view(np.int64))], ["at", "bits"])

        with shuffles_cleared(keys.sparkSession):
            found = keys.select(F.col(column).cast("long")).mapInArrow(bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (log_bits - 6), np.uint64)
        words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words, drop)


def in_blocks(keys: np.ndarray, n: np.ndarray, most: int) -> pa.RecordBatch:
    """Ascending keys and counts, cut by their first 32 bits: each block's differences by byte plane, which the shuffle's codec shortens, and counts up to ``most``."""
    top = (keys >> U(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(keys) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(keys))[: len(begin)]
    low = (keys & U(0xFFFFFFFF)).astype(np.uint32)
    gap = np.diff(low, prepend=np.uint32(0))
    gap[begin] = low[begin]
    n = np.minimum(n, most).astype(np.min_scalar_type(most))
    planes = [gap[b:e].view(np.uint8).reshape(-1, 4).T.tobytes() for b, e in zip(begin, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(top[begin], pa.int64()), pa.array(planes, pa.binary()), pa.array([n[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary())], ["block", "gaps", "n"])


def of_blocks(rows: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the blocks of one number, not yet summed."""
    keys, n = [], []
    for gaps, c in zip(rows.column("gaps").to_pylist(), rows.column("n").to_pylist(), strict=True):
        n.append(np.frombuffer(c, np.min_scalar_type(most)))
        keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64))
    return np.concatenate(keys) + (U(rows.column("block")[0].as_py()) << U(32)), np.concatenate(n).astype(np.int64)
