"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts are lower-cased and runs of ASCII white space become one space.  A document
is contaminated where some stretch of it is within ``most_edits`` (a share of the
item's length, in code points) of a benchmark item.

* A CGK random walk copies a character to the output at each step and advances
  with a coin drawn from the step and the character.  Two strings a few edits
  apart fall back into step, so their walks differ in few places (edit distance
  becomes Hamming distance).
* Items are read by windows that begin at each of their words; a document by
  windows that begin at each of its words, read as far as the item's windows
  are.  Every repetition has its own walk and its own sampled steps; windows whose sampled characters all agree
  become a candidate.  Samples are compared in stages, and only windows that
  agree so far walk on, which finds the same pairs as walking all to the end.
* An item of w words has up to w windows with as many walks each as its windows
  and its allowed edits ask for (``repetitions`` at least), so one stretch with
  hardly any edits is enough.  ``tests/llm`` measures the recall by length of
  item at the largest share of edits.
* Items too short for the walks (under ``SHORT`` or ``least`` code points, or with
  too few windows) are cut into one piece more than their
  allowed edits, so a leak holds one piece unchanged: every place of a piece in a
  document is a candidate, and nothing is missed.
* Each candidate places the whole item in the document; the item-sized window
  there, with room for the allowed edits, is verified by the exact
  (bit-parallel) edit distance.

Items are a stated query set against all documents: they are read in blocks of
at most ``BLOCK_BYTES`` (or one item).  Each block's tables are broadcast, its leaks
written to the shared folder, and the tables freed before the next block's.

Defined cases: items that are null or blank match nothing; null or blank documents
hold nothing; texts of any length are searched whole; repeated items are reported
under each of their ids; repeated rows are reported once per id, with the fewest
edits; a stretch with exactly the allowed edits counts; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, light_batches, sent, small_batches, splitmix, staged, texts_of, without_ids

#: Steps of a walk by the end of each stage, and the samples that the stage takes.
STAGES = ((30, 10), (48, 5))
CODE_BITS, TABLE_BITS = 28, 24  # of the first stage's code, and of its table at most
CLASSES = 32  # of bytes, in the first stage
SHORT = 60  # code points from which items are walked
MOST_WALKS = 24  # items that need more are searched by pieces
DENSE = 34  # how fast the windows that an item needs grow with its share of edits
BLOCK_BYTES = 8 << 20  # of items compared at a time
ROOM = 1 << 17  # windows walked at a time


def normalised(text: bytes) -> bytes:
    return b" ".join(text.decode().lower().encode().split())


def word_starts(joined: np.ndarray) -> np.ndarray:
    """Positions of the first byte of each word (words are divided by single spaces or line feeds)."""
    gap = (joined == 32) | (joined == 10)
    return np.flatnonzero(~gap & np.append(True, gap[:-1])).astype(np.int32)


class Walk:
    """One repetition: its coins, and the steps that it samples, in stages.

    The first stage is walked three steps at a time, by tables over the classes of
    the three next bytes: all that a walk can see until then.
    """

    def __init__(self, number: int):
        rng = np.random.default_rng(1_000 + number)
        self.coins = rng.integers(0, 2, (STAGES[-1][0], 256)).astype(np.int64)
        self.coins[:, 10] = 0  # texts end with a line feed, where a walk stays
        self.sampled, begin = np.zeros(STAGES[-1][0], bool), 0
        for end, samples in STAGES:
            self.sampled[begin + rng.choice(end - begin, samples, replace=False)] = True
            begin = end
        self.letter = rng.integers(0, 1 << 63, 256).astype(np.uint64)
        coins = rng.integers(0, 2, (STAGES[0][0], CLASSES))
        coins[:, 0] = 0  # the line feed's class
        code = rng.integers(0, 1 << CODE_BITS, (STAGES[0][0], CLASSES)) * self.sampled[: STAGES[0][0], None]
        next_three = np.arange(CLASSES**3)
        seen = np.stack([next_three >> 5 * k & CLASSES - 1 for k in range(3)])
        self.moves = []  # the code's change, and in the lowest two bits how far the walk gets
        for step in range(0, STAGES[0][0], 3):
            at, change = np.zeros(CLASSES**3, np.int64), np.zeros(CLASSES**3, np.int64)
            for k in range(step, step + 3):
                c = seen[at, next_three]
                change ^= code[k].take(c)
                at += coins[k].take(c)
            self.moves.append((change << 2 | at).astype(np.int32))

    def first(self, three: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code of the first stage's samples; ``at`` is moved to where the walks then stand."""
        code = np.zeros(len(at), np.int32)
        for moves in self.moves:
            move = moves.take(three.take(at))
            code ^= move
            at += move & 3
        return code >> 2

    def later(self, stage: int, text: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The key with a later stage's samples added; ``at`` is moved on."""
        for step in range(STAGES[stage - 1][0], STAGES[stage][0]):
            c = text.take(at)
            if self.sampled[step]:
                key = splitmix(key ^ self.letter.take(c))
            at += self.coins[step].take(c)
        return key


_walk = cache(Walk)  # made once by each worker


def next_threes(text: np.ndarray) -> np.ndarray:
    """The classes of the three bytes from each position on; the line feed has one of its own."""
    classes = np.where(text == 10, 0, 1 + text % (CLASSES - 1)).astype(np.int32)
    classes = np.append(classes, np.zeros(2, np.int32))
    return classes[:-2] | classes[1:-1] << 5 | classes[2:] << 10


def repetitions_for(length: int, edits: int, windows: int, least: int) -> int:
    """Walks that find an item at the target rate from its own windows and allowed edits.

    A key agrees where the stretch that it samples has hardly any edits, which is
    rarer the denser they are and the fewer windows there are to choose from.
    """
    return max(least, math.ceil(math.exp(DENSE * edits / length) / max(1, windows)))


def _short_code(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def _each_match(own: np.ndarray, first: np.ndarray, last: np.ndarray, item: np.ndarray, offset: np.ndarray):
    """Places in a text with every item and offset of their ranges of matches."""
    times = last - first
    each = np.repeat(np.arange(len(own)), times)
    which = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + first[each]
    return own[each], item[which], offset[which]


class Items:
    """One block of benchmark items with the tables to look windows up in."""

    def __init__(self, rows: list[tuple[int, str]], most_edits: float, repetitions: int, least: int):
        self.ids, self.texts = [], []
        for item_id, text in rows:
            text = normalised((text or "").encode())
            if text:
                self.ids.append(item_id)
                self.texts.append(text)
        self.edits = [int(most_edits * len(t.decode())) for t in self.texts]
        joined = np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8) if self.texts else np.empty(0, np.uint8)
        begin = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        starts = word_starts(joined)
        owner = np.searchsorted(begin, starts, "right") - 1
        reach = STAGES[-1][0] // 2  # about as far as a walk gets
        usable = np.bincount(owner[starts + reach < begin[owner + 1]], minlength=len(self.texts)).tolist()
        needed = np.array([repetitions_for(len(t.decode()), e, w, repetitions) for t, e, w in zip(self.texts, self.edits, usable, strict=True)], np.int64)
        short = np.array([len(t.decode()) < max(SHORT, least) for t in self.texts], bool) | (needed > max(MOST_WALKS, repetitions))
        needed[short] = 0
        self.pieces = self._pieces(np.flatnonzero(short).tolist())
        self.bits = min(TABLE_BITS, max(16, (128 * len(starts)).bit_length()))
        self.walks, three = [], next_threes(joined)
        for r in range(needed.max(initial=0)):
            walk, some = _walk(r), needed[owner] > r
            own, at = owner[some], starts[some].astype(np.int64)
            code = walk.first(three, at)
            table = np.zeros(1 << self.bits, bool)
            table[code & (1 << self.bits) - 1] = True
            key, keys = code.astype(np.uint64), []
            for stage in range(1, len(STAGES)):
                key = walk.later(stage, joined, key, at)
                keys.append(np.unique(key))
            inside = joined[at] != 10  # a walk that has met the item's end would only match a document's end
            order = np.flatnonzero(inside)[np.argsort(key[inside], kind="stable")]
            self.walks.append((table, keys[:-1], key[order], own[order].astype(np.int64), (starts[some] - begin[own])[order].astype(np.int64)))

    def _pieces(self, numbers: list[int]) -> list[tuple]:
        """By width in bytes (8 at most): the sorted leading bytes of the items' pieces, a table of them, the items and offsets."""
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for t in numbers:
            text = self.texts[t].decode()
            cuts = np.linspace(0, len(text), min(self.edits[t] + 1, len(text)) + 1).astype(int).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                piece = text[lo:hi].encode()[:8]
                by_width.setdefault(len(piece), []).append((int.from_bytes(piece, "little"), t, len(text[:lo].encode())))
        out = []
        for width, rows in by_width.items():
            rows.sort()
            codes, item, offset = (np.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            table = np.zeros(1 << 16, bool)
            table[_short_code(codes)] = True
            out.append((width, codes, table, item, offset))
        return out

    def _places(self, text: np.ndarray):
        """Candidates by unchanged pieces of short items."""
        for width, codes, table, item, offset in self.pieces:
            if len(text) < width:
                continue
            code = np.zeros(len(text) - width + 1, np.uint64)
            for k in range(width):
                code |= text[k : k + len(code)].astype(np.uint64) << np.uint64(8 * k)
            own = np.flatnonzero(table.take(_short_code(code)))
            first, last = np.searchsorted(codes, code[own], "left"), np.searchsorted(codes, code[own], "right")
            yield _each_match(own, first, last, item, offset)

    def candidates(self, text: np.ndarray, starts: np.ndarray):
        """Arrays of window start, item number and the window's offset in the item."""
        found, three = [(np.empty(0, np.int64),) * 3, *self._places(text)], next_threes(text)
        for number, (table, partial_keys, keys, owner, offset) in enumerate(self.walks):
            walk = _walk(number)
            for lo in range(0, len(starts), ROOM):
                own = starts[lo : lo + ROOM].astype(np.int64)
                at = own.copy()
                code = walk.first(three, at)
                may = np.flatnonzero(table.take(code & (1 << self.bits) - 1))
                own, at, key = own[may], at[may], code[may].astype(np.uint64)
                for stage in range(1, len(STAGES)):
                    key = walk.later(stage, text, key, at)
                    if stage <= len(partial_keys):
                        known = partial_keys[stage - 1]
                        may = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                        own, at, key = own[may], at[may], key[may]
                first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                found.append(_each_match(own, first, last, owner, offset))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def least_edits(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any stretch of ``text``, and where the first such stretch ends."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1
        up = (left | (full & ~(diagonal | right))) & full
        down = right & diagonal & full
        if score < best:
            best, end = score, j + 1
    return best, end


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("allowed", pa.int64())])


def _verified(items: Items, text: bytes, at: np.ndarray, item: np.ndarray, offset: np.ndarray) -> dict[int, int]:
    """Least edits of each item that the document really holds, from one document's candidates."""
    best: dict[int, int] = {}
    seen: dict[int, int] = {}
    begin = at - offset
    for k in np.lexsort((begin, item)).tolist():
        t, q = int(item[k]), int(begin[k])
        length, room = len(items.texts[t]), 4 * items.edits[t] + 4  # bytes; a code point has up to four
        if best.get(t) == 0 or (t in seen and q - seen[t] <= room // 4):
            continue
        seen[t] = q
        lo, hi = max(0, q - 2 * room), q + length + 2 * room
        around = text[lo:hi].decode(errors="ignore")
        edits, _ = least_edits(items.texts[t].decode(), around)
        if edits <= items.edits[t] and edits < best.get(t, edits + 1):
            best[t] = edits
    return best


def _find(batches, items):
    items = items.value
    for batch in small_batches(batches, "text"):
        texts = [normalised(t) for t in texts_of(batch.column("text"))]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        at, item, offset = items.candidates(joined, word_starts(joined))
        if not len(at):
            continue
        owner = np.searchsorted(begin, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        owner, at, item, offset = owner[order], at[order], item[order], offset[order]
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        ids, rows = batch.column("doc_id").to_pylist(), []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d = int(owner[lo])
            for t, edits in _verified(items, texts[d], at[lo:hi] - begin[d], item[lo:hi], offset[lo:hi]).items():
                rows.append((ids[d], items.ids[t], edits, items.edits[t]))
        if rows:
            yield as_batch(_HIT, *(list(c) for c in zip(*rows, strict=True)))


def _blocks(benchmark: DataFrame):
    block, held = [], 0
    for row in benchmark.toLocalIterator():
        size = len((row[1] or "").encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = 0.15, repetitions: int = 3, least: int = 32, id_col: str = "doc_id",
          text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, allowed`` for every benchmark item that a document holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl, found = "doc_id long, item_id long, edits long, allowed long", None
    for rows in _blocks(benchmark.select(F.col(item_id).cast("long"), item_text)):
        with sent(spark, Items(rows, most_edits, repetitions, least)) as items:
            hits = staged(docs.transform(light_batches).mapInArrow(partial(_find, items=items), ddl), "leaks")
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], ddl)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("allowed").alias("allowed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    return without_ids(docs, leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_id"), id_col)
