"""Words, lines and hashes of many texts at once, with numpy inside a task.

A task takes its texts in pieces of about `PIECE` bytes (a longer text is a piece of its own), joined
by line feeds, so that one array operation serves hundreds of documents. Whole texts, never prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_rng = np.random.default_rng(20240607)
_OF_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, PIECE + (1 << 16)), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Text:
    """A piece: `data` bytes, each text followed by a line feed; text i is data[begin[i]:end[i]]."""

    def __init__(self, texts: list[bytes], fold_case: bool = False):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold_case:
            self.data = LOWER[self.data]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(lengths + 1) - 1
        self.begin = self.end - lengths
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.begin)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word, in order."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~SPACE[self.data]
        turn = np.diff(inside)
        # the last byte is a line feed, so every word that begins also ends
        return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        end = np.flatnonzero(self.data == 10)
        return np.concatenate(([0], end[:-1] + 1)), end

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text in which each position lies."""
        return np.searchsorted(self.begin, at, "right") - 1

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[begin:end]; equal bytes have equal hashes wherever they stand."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_OF_BYTE[self.data] * up[:-1], out=self._sums[1:])
        return mixed((self._sums[end] - self._sums[begin]) * down[begin])

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one a byte) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.end] - sums[self.begin]


def in_sequence(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as bytes) of runs of rows with about `most` bytes."""
    values = batch.column(column).cast(pa.large_binary())
    sizes = np.asarray(pc.binary_length(values).fill_null(0)) if len(values) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(values):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
        yield row, values.slice(row, stop - row).to_pylist()
        row = stop
