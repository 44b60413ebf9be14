"""Counting quotient filters over arrays: lossless counters of whole numbers of a fixed number of bits.

A number is permuted (invertibly, within its bits), the upper bits of the result are its quotient and
the others its remainder. The filter keeps, in order, one bit for each quotient that occurs, one bit
for each slot that ends the run of a quotient, the remainders of the slots and the counts above one.
The full remainder is kept, so a filter gives back exactly the numbers that went in. Sorted by
quotient and remainder, filters merge like sorted lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers below 2 ** bits."""
    half, mask = np.uint64(max(1, (bits + 1) // 2)), _mask(bits)
    x = x.astype(np.uint64)
    for odd in _ODD:
        x = (x * np.uint64(odd)) & mask
        x = x ^ (x >> half)
    return x


def restored(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of `permuted`."""
    half, mask = np.uint64(max(1, (bits + 1) // 2)), _mask(bits)
    x = x.astype(np.uint64)
    for odd in reversed(_ODD):
        x = x ^ (x >> half)  # the upper half is unchanged, so this undoes itself
        x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
    return x


@dataclass
class Filter:
    """Numbers of `bits` bits, permuted and rising, and the count of each."""

    bits: int
    values: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(values: np.ndarray, bits: int) -> Filter:
        """Count permuted values."""
        values = np.sort(values)
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        begin = np.flatnonzero(new)
        return Filter(bits, values[begin], np.diff(np.append(begin, len(values))).astype(np.int64))

    @staticmethod
    def merged(filters: list[Filter]) -> Filter:
        """One filter with the sums of the counts of all."""
        values, counts = np.concatenate([f.values for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")  # merges the rising stretches
        values = values[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        begin = np.flatnonzero(new)
        return Filter(filters[0].bits, values[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts)

    def remainder_bits(self) -> int:
        """Remainders take whole bytes, as few as leave no more quotients than slots need."""
        spare = self.bits - max(0, int(len(self.values) - 1).bit_length())
        return min(self.bits, -(-max(spare, 0) // 8) * 8)

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of permuted values, 0 for those that are not there: a search in the run of the quotient."""
        if not len(self.values):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        return np.where(self.values[at] == wanted, self.counts[at], 0)

    def to_bytes(self) -> bytes:
        n, r = len(self.values), self.remainder_bits()
        quotient = self.values >> np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
        last = np.ones(n, bool)
        last[:-1] = quotient[1:] != quotient[:-1]
        occupied = np.zeros(1 << (self.bits - r), np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        remainders = self.values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : r // 8] if r % 8 == 0 else (self.values & _mask(r)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : r // 8 + 1]
        more = self.counts > 1
        head = np.array([self.bits, r, n, int(more.sum())], "<i8").tobytes()
        body = np.packbits(occupied).tobytes() + np.packbits(last).tobytes() + np.packbits(more).tobytes()
        body += np.ascontiguousarray(remainders.T).tobytes() + np.ascontiguousarray(self.counts[more].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def from_bytes(data: bytes) -> Filter:
        bits, r, n, m = np.frombuffer(data, "<i8", 4).tolist()
        body, at = zstandard.ZstdDecompressor().decompress(data[32:]), 0

        def flags(size: int) -> np.ndarray:
            nonlocal at
            whole = -(-size // 8)
            out = np.unpackbits(np.frombuffer(body, np.uint8, whole, at), count=size).astype(bool)
            at += whole
            return out

        occupied, last, more = flags(1 << (bits - r)), flags(n), flags(n)
        width = -(-r // 8)
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        counts = np.ones(n, np.int64)
        counts[more] = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * m, at).reshape(8, m).T).view("<i8").ravel()
        run = np.cumsum(last) - last  # the run of each slot
        quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
        high = quotient << np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
        return Filter(bits, high | values.view("<u8").ravel(), counts)
