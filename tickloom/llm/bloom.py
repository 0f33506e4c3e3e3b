"""Bloom filters built on the executors, with a stated bound on their size.

A filter has at most ``MOST_BITS`` bits (64 MB), whatever the input; beyond the
keys that this serves well it lets more keys through, and every use is followed
by an exact step, so results do not depend on it.  Tasks send their bits as
compressed segments; segments are merged by segment number, so no task holds
more than one filter and the driver receives one filter's bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tickloom.llm.common import as_batch, light_batches, runs, splitmix

MOST_BITS = 1 << 29
LEAST_BITS = 1 << 16
HASHES = 4
SEGMENTS = 64
_SEGMENT = pa.schema([("seg", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_DDL = "seg int, once binary, twice binary"


def bits_for(keys: float, per_key: int = 8) -> int:
    """A power of two of bits for so many keys, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, int(keys) * per_key - 1).bit_length()))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` bit positions of each uint64 key, as rows."""
    a = splitmix(keys)
    b = splitmix(a) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(HASHES)])


class Pair:
    """Two filters over one set of positions: seen once, and seen again from another document or task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        """``keys``: uint64, a key as often as there are documents with it."""
        p = np.concatenate(positions(keys, self.bits)) if len(keys) else np.empty(0, np.uint64)
        # a position met twice by different keys counts as met again: more suspects, none missed
        p.sort()
        again = np.unique(p[1:][p[1:] == p[:-1]])
        p = np.unique(p)
        had = p[self._has(self.once, p)]
        for to, at in ((self.twice, np.concatenate([again, had])), (self.once, p)):
            np.bitwise_or.at(to, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    @staticmethod
    def _has(held: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (held[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def segments(self) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        once, twice = (x.reshape(SEGMENTS, -1) for x in (self.once, self.twice))
        return as_batch(_SEGMENT, np.arange(SEGMENTS, dtype=np.int32), [z.compress(x.tobytes()) for x in once], [z.compress(x.tobytes()) for x in twice])


def contains(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter ``held`` may hold each uint64 key."""
    out = np.ones(len(keys), bool)
    for p in positions(keys, len(held) * 8):
        out &= Pair._has(held, p)
    return out


def _merge(batches):
    z, put = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    seg, once, twice = None, None, None

    def out():
        return as_batch(_SEGMENT, [seg], [put.compress(once.tobytes())], [put.compress(twice.tobytes())])

    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(z.decompress(x), np.uint8) for x in (a, b))
            if s != seg:
                if seg is not None:
                    yield out()
                seg, once, twice = s, np.zeros_like(a), np.zeros_like(b)
            twice |= b | (once & a)
            once |= a
    if seg is not None:
        yield out()


def gathered(segments: DataFrame, which: str, bits: int) -> np.ndarray:
    """Merge the tasks' segments by number and bring one filter (at most 64 MB) to the driver."""
    merged = segments.repartition("seg").sortWithinPartitions("seg").transform(light_batches).mapInArrow(_merge, _DDL)
    z, held = zstandard.ZstdDecompressor(), np.zeros(bits // 8, np.uint8)
    width = bits // 8 // SEGMENTS
    for row in merged.select("seg", which).collect():
        held[row[0] * width : (row[0] + 1) * width] = np.frombuffer(z.decompress(bytes(row[1])), np.uint8)
    return held


def of_longs(keys: DataFrame, count: int) -> np.ndarray:
    """One filter over a single long column (nulls are left out)."""
    bits = bits_for(count, 10)

    def build(batches):
        pair = Pair(bits)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                pair.add(v.astype(np.int64).view(np.uint64))
        yield pair.segments()

    return gathered(keys.transform(light_batches).mapInArrow(build, _DDL), "once", bits)
