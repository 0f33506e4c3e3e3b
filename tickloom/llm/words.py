"""Hashes of all words of many texts at once, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm.common import splitmix

PIECE = 1 << 16  # bytes looked at together
_BASE = int(splitmix(np.array([12345], np.uint64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WRAP = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Splitter:
    """Cuts texts at the given ASCII bytes and hashes what lies between them, A-Z as a-z.

    A word's hash is a polynomial over its bytes modulo 2**64, read off running
    sums at its two ends, and its length, through a finaliser.  A text of any
    length is taken in pieces; a word may span pieces.
    """

    def __init__(self, separators: bytes):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.value = splitmix(np.arange(1, 257, dtype=np.uint64))
        self.value[65:91] = self.value[97:123]
        self.up, self.down = _powers(_BASE), _powers(_INVERSE)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The uint64 hashes of all words in order, and how many each text has (null: none)."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        flat = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        return self._hashes(flat, offsets - offsets[0])

    def of(self, word: str) -> int:
        """One word's hash."""
        return int(self.words(pa.array([word]))[0][0])

    def _hashes(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, sums_at, sums_to, shifts = [], [], [], [], []
        last, total, scale, back = False, 0, 1, 1
        for a in range(0, len(flat), PIECE):
            x = flat[a : a + PIECE]
            inside = self.inside[x]
            before = np.empty_like(inside)
            before[0], before[1:] = last, inside[:-1]
            joined = before.copy()
            lo, hi = np.searchsorted(offsets, [a, a + len(x)])
            joined[offsets[lo:hi] - a] = False  # a text begins here
            joined &= inside
            begin, end = np.flatnonzero(inside & ~joined), np.flatnonzero(before & ~joined)
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(self.value[x] * self.up[: len(x)], out=sums[1:])
            sums *= np.uint64(scale)
            sums += np.uint64(total)
            starts.append(begin + a)
            ends.append(end + a)
            sums_at.append(sums[begin])
            sums_to.append(sums[end])
            shifts.append(self.down[begin] * np.uint64(back))
            last, total = bool(inside[-1]), int(sums[-1])
            scale, back = scale * int(self.up[-1]) * _BASE & _WRAP, back * int(self.down[-1]) * _INVERSE & _WRAP
        if last:
            ends.append(np.array([len(flat)]))
            sums_to.append(np.array([total], np.uint64))
        if not starts:
            return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        hashes = (np.concatenate(sums_to) - np.concatenate(sums_at)) * np.concatenate(shifts)
        hashes = splitmix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        of_text = np.searchsorted(offsets, starts, "right") - 1
        return hashes, np.bincount(of_text, minlength=len(offsets) - 1)


#: Words between ASCII white space.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but letters and digits.
NO_TERM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
