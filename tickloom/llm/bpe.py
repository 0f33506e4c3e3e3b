"""Byte-level BPE encoding and decoding of whole texts.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton
(pyahocorasick) finds every vocabulary token in a piece of text.  A piece is
encoded by backtracking: take the longest token at a position, keep it if it is
compatible with the token before it, else try the next shorter one, and step
back when none is left.  Two tokens are compatible when merging their joined
bytes by rank gives just these two; the answer is memoised.  A sequence whose
neighbours are all compatible is the one that the merges by rank produce, and
each position is given up at most once, so time is linear in the piece.

Defined cases: a null text counts as empty and has no ids; a piece that is
itself a token becomes that token; very long pieces need no recursion, and memory
for their ids and one stretch of matches only; repeated rows and rows without an
id each come back; of other columns only those asked for are carried, and one
named like the result gets an underscore there.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, ddl_of, fresh, light_batches, quoted, small_batches, texts_of

#: Pieces remembered by a worker; the table is emptied when full.
MOST_PIECES = 1 << 19
MOST_PAIRS = 1 << 19
#: Longer pieces are encoded each time rather than remembered.
LONG_PIECE = 64
STRETCH = 1 << 14  # bytes of a piece whose matches are held at a time


class _Matches:
    """The tokens that begin at each position of a piece, longest last, found a stretch at a time."""

    def __init__(self, automaton, piece: str, longest: int):
        self.automaton, self.piece, self.longest = automaton, piece, longest
        self.held: dict[int, list] = {}

    def at(self, position: int) -> list[tuple[int, int]]:
        number = position // STRETCH
        stretch = self.held.get(number)
        if stretch is None:
            if len(self.held) > 2:
                self.held.clear()
            begin = number * STRETCH
            stretch = self.held[number] = [[] for _ in range(min(STRETCH, len(self.piece) - begin))]
            for end, (rank, length) in self.automaton.iter(self.piece[begin : begin + STRETCH + self.longest]):
                if end - length + 1 < STRETCH:
                    stretch[end - length + 1].append((length, rank))  # ends grow, so the longest comes last
        return stretch[position - number * STRETCH]


class Coder:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merge neighbours of lowest rank, one after another (for short byte strings)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merges produce the token from its bytes."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        n = len(piece)
        matches = _Matches(self.automaton, piece.decode("latin-1"), self.longest)
        given_up = bytearray(n + 1)
        path = array("q")  # ids
        at = 0
        options = list(matches.at(0))
        while at < n:
            while options:
                length, rank = options.pop()
                if not given_up[at + length] and self.reachable(rank) and (not path or self.compatible(path[-1], rank)):
                    path.append(rank)
                    at += length
                    options = list(matches.at(at)) if at < n else []
                    break
            else:
                given_up[at] = 1
                shorter = len(self.tokens[path.pop()])
                at -= shorter
                options = [x for x in matches.at(at) if x[0] < shorter]
        return path.tolist()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, known = [], self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(known) >= MOST_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(ranks_file: str, pattern: str) -> Coder:
    """One coder for a worker process, kept across tasks."""
    return Coder(ranks_file, pattern)


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Whole texts to ids: the id column, the ``carry`` columns and ``ids`` (binary, little-endian unsigned 32-bit)."""
    own, text = quoted([id_col, *(carry or [])]), quoted([text_col])
    (carried_text,) = fresh([id_col, *(carry or [])], "text")
    (ids_col,) = fresh([id_col, *(carry or [])], "ids")
    kept = docs.select(*own, F.col(*text).alias(carried_text))
    ddl = f"{ddl_of(kept.schema[:-1])}, {ids_col} binary"

    def run(batches):
        own = coder(ranks_file, pattern)
        for batch in small_batches(batches, carried_text):
            ids = [own.encode(t.decode()) for t in texts_of(batch.column(carried_text))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], ids_col])

    return kept.transform(light_batches).mapInArrow(run, ddl)


def decode(encoded: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Ids back to ``text`` (the bytes must be UTF-8, as they are for ids that ``encode`` made)."""
    kept = encoded.select(id_col, ids_col)
    ddl = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, `text` string"

    def run(batches):
        own = coder(ranks_file, pattern)
        for batch in small_batches(batches, ids_col):
            texts = [own.decode(x or b"").decode() for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    return kept.transform(light_batches).mapInArrow(run, ddl)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches):
        own = coder(ranks_file, pattern)
        for batch in small_batches(batches, "text"):
            ids = [own.encode(t.decode()) for t in texts_of(batch.column("text"))]
            yield as_batch(
                _DIGEST,
                batch.column("doc_id"),
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
            )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.transform(light_batches).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
