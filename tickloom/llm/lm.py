"""N-gram language model in a log-frequency Bloom filter.

Training counts all n-grams up to ``order`` over all training texts.  Tasks count
their own n-grams and send each owner (a range of hashes) one packed list of
sorted hashes and counts; owners add the lists up.  Counts are quantised to
levels, exact up to 8 and then steps of a quarter.  The filter holds an n-gram of
level j under the keys (n-gram, 1) to (n-gram, j), so a count is read by probing
level after level until one is missing: it is never read too low, and too high by
a level about once in a hundred probes.  An n-gram is looked for only where both
shorter n-grams inside it were found, and never counts more than they do.

The filter is broadcast, so its size is bounded (``most_bytes``) whatever the
corpus.  Where the n-grams of all levels need more, the order with the most keys
is held from a higher count on; how many keys that spares is known from the
histogram of all counts.  N-grams under that floor are not lost: what the filter
does not hold is asked of the owners, who answer with the exact count, 0 included.
A task sends each owner one list of its texts' open n-grams and leaves a record of
its texts, in which every token has a level of the filter or a place in the lists;
the answers meet that record.

Smoothing is Witten-Bell's, from the shortest n-gram up:

    P(w | h) = (c(h w) + M(h) P(w | h')) / (c(h) + M(h))

M(h) is how many different words follow h.  That is c(h)**b, with b per order such
that the sum over all histories is the number of different n-grams.  Every text is followed by an end, which is also the
history of a text's first word.

Beside the model's score stands the base score of the exact counts of single
words.  The most frequent words travel with the filter, words that a filter of all
words does not know have count 0, and the others are asked of the owners too.

Defined cases: a null or empty text is its end alone; without training texts every
probability is that of an unknown word; rows without an id, repeated rows and
other columns are as good as any, whatever their names; texts of any length are
taken whole.  Words are told apart by 64-bit hashes, longer n-grams by 48 bits.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, discard, light_batches, runs, sent, shared_folder, small_batches, splitmix, staged
from tickloom.llm.words import SPACE, Splitter

MOST_BYTES = 1 << 26  # of the filter
BITS_EACH = 10  # of the filter for a key, at least (or the floor of an order rises)
PROBES = 5
SEGMENTS = 256  # ranges of hashes that the filter is built by
HEAD = 1 << 17  # most frequent words whose exact counts travel with the filter, at most
OWNED = 1 << 22  # bytes of text for each owner of counts
FLUSH = 1 << 20  # tokens that a task counts before it sends
ASKED = 1 << 19  # tokens that a task looks up before it sends
PARTS = 4  # of the texts, scored one after the other where n-grams are asked of owners: bounds the disk that lists take
FOUND = 256  # codes under this are levels, those from here on places among the n-grams asked for
U = np.uint64
END = splitmix(np.array([0xE0F], U))[0]
_ODD = splitmix(np.arange(1, 33, dtype=U)) | U(1)


def _levels() -> np.ndarray:
    """The least count of each level."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


LEAST = _levels()
#: What a level stands for: the mean of its counts; 0 for none.
VALUE = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, [float(LEAST[-1])]])


# --- counting -------------------------------------------------------------------------------------------------------


def _pack(sorted_values: np.ndarray) -> bytes:
    """Ascending integers as gaps, by byte planes."""
    gaps = np.diff(sorted_values.astype(U), prepend=U(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _plain(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(U).view(np.uint8).reshape(-1, 8).T.tobytes())


def _opened(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T.copy().view(U).ravel()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_opened(blob), dtype=U)


def _tokens(splitter: Splitter, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes with an end after each text, and where each text begins."""
    words, sizes = splitter.words(column)
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(words) + len(sizes), END)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own] = words
    return out, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)


def _grams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that end at each token; 0 where the text has not that many words before it.

    The history of a first word is an end, so bigrams exist everywhere.
    """
    out = [tokens]
    place = np.arange(len(tokens)) - np.repeat(first, np.diff(np.append(first, len(tokens))))
    for o in range(2, order + 1):
        shorter = np.concatenate([[END if o == 2 else U(0)], out[-1][:-1]])
        key = splitmix(shorter * _ODD[o] + tokens)
        key[place < o - 2] = 0
        out.append(key)
    return out


_COUNTED = pa.schema([("owner", pa.int32()), ("o", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNTED_DDL = "owner int, o int, keys binary, counts binary"


def _sent_lists(grams: list[np.ndarray], owner_bits: int):
    for o, keys in enumerate(grams, 1):
        keys = keys[keys != 0]
        keys, counts = np.unique(keys if o == 1 else keys >> U(16), return_counts=True)
        owners = (keys >> U((64 if o == 1 else 48) - owner_bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, owners[1:] != owners[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if spans:
            yield as_batch(_COUNTED, owners[cuts[:-1]], [o] * len(spans), [_pack(keys[a:b]) for a, b in spans], [_plain(counts[a:b]) for a, b in spans])


def _count(batches, order: int, owner_bits: int):
    splitter, held, size = Splitter(SPACE), [], 0
    for batch in small_batches(batches, "text"):
        held.append(_grams(*_tokens(splitter, batch.column("text")), order))
        size += len(held[-1][0])
        if size >= FLUSH:
            yield from _sent_lists([np.concatenate(x) for x in zip(*held, strict=True)], owner_bits)
            held, size = [], 0
    if held:
        yield from _sent_lists([np.concatenate(x) for x in zip(*held, strict=True)], owner_bits)


_GRAMS = pa.schema([("owner", pa.int32()), ("o", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("levels", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])
_GRAMS_DDL = "owner int, o int, n long, total long, levels array<long>, keys binary, counts binary"


def _add(batches):
    """The lists of each owner and order added up; counts stay exact."""
    for table in runs(batches, ["owner", "o"]):
        groups: dict = {}
        for owner, o, keys, counts in zip(*(c.to_pylist() for c in table.columns), strict=True):
            groups.setdefault((owner, o), []).append((keys, counts))
        for (owner, o), lists in groups.items():
            keys = np.concatenate([_unpacked(k) for k, _ in lists])
            counts = np.concatenate([_opened(c) for _, c in lists]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[at], np.add.reduceat(counts[order], at)
            levels = np.bincount(np.searchsorted(LEAST, counts, "right"), minlength=len(LEAST) + 1)
            yield as_batch(_GRAMS, [owner], [o], [len(keys)], [int(counts.sum())], [levels.tolist()], [_pack(keys)], [_plain(counts)])


# --- filter ---------------------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    return splitmix(keys + np.array([level], U) * _ODD[:1])


def _places(keys: np.ndarray, level: int, each: int):
    """Where the probes of (key, level) lie inside the key's segment of ``each`` bits."""
    a = _mixed(keys, level)
    b = (a >> U(32)) | U(1)
    for _ in range(PROBES):
        yield a & U(each - 1)
        a = a + b


def _segment(keys: np.ndarray, levels: np.ndarray, floor: int, each: int) -> bytes:
    """The bits that n-grams of one segment set: a key for each level from the floor to their own."""
    held = np.zeros(each, bool)
    for level in range(floor, int(levels.max(initial=0)) + 1):
        for p in _places(keys[levels >= level], level, each):
            held[p.astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _has(held: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """Whether the filter may hold (key, level); keys that one probe misses are not probed again."""
    each = len(held) * 8 // SEGMENTS
    alive, base = np.arange(len(keys)), (keys >> U(40)) * U(each)
    a = _mixed(keys, level)
    b = (a >> U(32)) | U(1)
    for _ in range(PROBES):
        p = base + (a & U(each - 1))
        hit = np.flatnonzero((held[(p >> U(3)).view(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1)
        if len(hit) < len(p):
            alive, base, a, b = alive[hit], base[hit], a[hit], b[hit]
        a = a + b
    out = np.zeros(len(keys), bool)
    out[alive] = True
    return out


def read_levels(held: np.ndarray, keys: np.ndarray, floor: int) -> np.ndarray:
    """The level of each 48-bit key, 0 if it is not held at the floor: level after level is probed until one is missing."""
    out = np.zeros(len(keys), np.int64)
    alive, level = np.arange(len(keys)), floor
    while len(alive) and level <= len(LEAST):
        alive = alive[_has(held, keys[alive], level)]
        out[alive] = level
        level += 1
    return out


_BITS = pa.schema([("seg", pa.int32()), ("held", pa.binary())])


def _built(batches, each: int, floors: list[int]):
    """The segments' bits of each owner's n-grams."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for o, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("o", "keys", "counts")), strict=True):
            keys, levels = _unpacked(keys), np.searchsorted(LEAST, _opened(counts).astype(np.int64), "right")
            keys = keys >> U(16) if o == 1 else keys
            keep = levels >= floors[o - 1]
            keys, levels = keys[keep], levels[keep]
            cuts = np.searchsorted(keys, np.arange(SEGMENTS + 1, dtype=U) << U(40))
            for seg in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                lo, hi = cuts[seg], cuts[seg + 1]
                yield as_batch(_BITS, [seg], [z.compress(_segment(keys[lo:hi], levels[lo:hi], floors[o - 1], each))])


def _or(batches):
    z, put = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    at, total = None, None
    for batch in batches:
        for seg, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(z.decompress(blob), np.uint8)
            if seg != at:
                if at is not None:
                    yield as_batch(_BITS, [at], [put.compress(total.tobytes())])
                at, total = seg, np.zeros_like(own)
            total |= own
    if at is not None:
        yield as_batch(_BITS, [at], [put.compress(total.tobytes())])


# --- model ----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs on a worker, and the exact counts of all n-grams as the owners' table."""

    held: np.ndarray
    floors: list[int]  # least level held, by order
    powers: list[float]  # different words after a history of count c: c**power, by order from 2 on
    total: int  # tokens
    distinct: int
    head: tuple[np.ndarray, np.ndarray]  # most frequent words, sorted by hash, and their counts
    owner_bits: int
    grams: DataFrame


def floors_for(numbers: np.ndarray, most_keys: float) -> list[int]:
    """The least level of each order (rows of ``numbers``: n-grams by level from 1) such that the filter's keys fit.

    Floors never fall with the order, so that both shorter n-grams of a held one are held.
    """
    floors = [1] * len(numbers)
    above = np.cumsum(numbers[:, ::-1], axis=1)[:, ::-1]  # keys at a level: n-grams of that level or over
    keys = lambda o: above[o, floors[o] - 1 :].sum()
    while sum(map(keys, range(len(floors)))) > most_keys:
        worst = max(range(len(floors)), key=lambda o: (keys(o), o))
        for o in range(worst, len(floors)):
            floors[o] = max(floors[o], floors[worst] + (o == worst))
        if floors[worst] > numbers.shape[1] - 1:
            break
    return floors


def _power(histories: np.ndarray, different: float) -> float:
    """b such that the sum of c**b over the histories (by level) is the number of different n-grams."""
    lo, hi = -4.0, 1.0
    for _ in range(60):
        b = (lo + hi) / 2
        lo, hi = (b, hi) if float((histories * VALUE[1 : len(histories) + 1] ** b).sum()) < different else (lo, b)
    return (lo + hi) / 2


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver collects its garbage: for results that are staged."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _in_buckets(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows as tasks make them, written once in buckets by ``key``, so that groups by it are read without a shuffle."""
    spark, made = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows.write.option("path", f"{shared_folder(spark)}/tickloom/{made}").bucketBy(_buckets(spark), key).saveAsTable(made)
    return spark.table(made)


def train(docs: DataFrame, text_col: str = "text", order: int = 3, most_bytes: int = MOST_BYTES) -> Model:
    """The model of the texts of ``docs``.  To the driver come a histogram, the filter and at most ``HEAD`` frequent words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    owner_bits = min(20, max(4, (size // OWNED).bit_length()))
    counted = docs.transform(light_batches).mapInArrow(lambda b: _count(b, order, owner_bits), _COUNTED_DDL)
    # equal hashes meet under one owner; a word in every text is one entry of each list
    added = counted.repartition(_buckets(spark), "owner").sortWithinPartitions("owner", "o").transform(light_batches).mapInArrow(_add, _GRAMS_DDL)
    with freed(spark):
        grams = _in_buckets(added, "grams", "owner")

    numbers, totals = np.zeros((order, len(LEAST)), np.int64), np.zeros(order, np.int64)
    for r in grams.select("o", F.posexplode("levels").alias("level", "n")).where("n > 0").groupBy("o", "level").agg(F.sum("n").alias("n")).collect():
        numbers[r.o - 1, r.level - 1] = r.n
    for r in grams.groupBy("o").agg(F.sum("total").alias("total")).collect():
        totals[r.o - 1] = r.total
    most_keys = most_bytes * 8 // BITS_EACH
    floors = floors_for(numbers, most_keys)
    keys = sum(int((row[f - 1 :] * np.arange(1, len(row) - f + 2)).sum()) for row, f in zip(numbers, floors, strict=True))
    bits = min(most_bytes * 8, max(1 << 16, 1 << (keys * BITS_EACH).bit_length()))
    held = np.zeros(bits // 8, np.uint8)
    made = grams.select("o", "keys", "counts").transform(light_batches).mapInArrow(lambda b: _built(b, bits // SEGMENTS, floors), "seg int, held binary")
    made = made.repartition("seg").sortWithinPartitions("seg").transform(light_batches).mapInArrow(_or, "seg int, held binary")
    z, width = zstandard.ZstdDecompressor(), bits // 8 // SEGMENTS
    for seg, blob in made.toLocalIterator():
        held[seg * width : (seg + 1) * width] = np.frombuffer(z.decompress(bytes(blob)), np.uint8)

    powers = [_power(numbers[o - 1], float(numbers[o].sum())) for o in range(1, order)]
    # the histogram tells from which level on at most so many words lie, so no more than these leave the tasks
    least = int(LEAST[np.argmax(numbers[0, ::-1].cumsum()[::-1] <= HEAD)])
    counts = grams.where("o = 1").select("keys", "counts").transform(light_batches).mapInArrow(lambda b: _words(b, least), "word long, c long")
    head = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 2)
    words = head[:, 0].view(U) if len(head) else np.empty(0, U)
    by_hash = np.argsort(words)
    return Model(held, floors, powers, int(totals[0]), int(numbers[0].sum()), (words[by_hash], head[by_hash, 1]), owner_bits, grams)


_WORDS = pa.schema([("word", pa.int64()), ("c", pa.int64())])


def _words(batches, least: int):
    for batch in batches:
        for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, counts = _unpacked(keys).view(np.int64), _opened(counts).astype(np.int64)
            yield as_batch(_WORDS, keys[counts >= least], counts[counts >= least])


# --- scoring --------------------------------------------------------------------------------------------------------


def _codes(m: Model, grams: list[np.ndarray], word_levels: np.ndarray, open_words: np.ndarray | None = None):
    """Of each order from 2 on: every token's code, and the sorted n-grams that the codes from ``FOUND`` on are places in.

    A code under ``FOUND`` is the filter's level, 0 where the n-gram cannot be there: one of the shorter n-grams inside it is not.
    ``open_words`` may be there though the filter has no level for them.
    """
    there = word_levels > 0 if open_words is None else (word_levels > 0) | open_words
    for o in range(2, len(grams) + 1):
        key = grams[o - 1]
        first = there[-1] if o == 2 else False  # the last token is an end, the history of a text's first word
        wanted = np.flatnonzero((key != 0) & np.concatenate([[first], there[:-1]]) & there)
        own, back = np.unique(key[wanted] >> U(16), return_inverse=True)
        code = read_levels(m.held, own, m.floors[o - 1])
        asked = np.flatnonzero(code == 0) if m.floors[o - 1] > 1 else np.empty(0, np.int64)
        code[asked] = FOUND + np.arange(len(asked))
        codes = np.zeros(len(key), np.int64)
        codes[wanted] = code[back]
        there = codes > 0
        yield codes, own[asked]


def _smoothed(m: Model, counts: list[np.ndarray], whole: list[np.ndarray]) -> np.ndarray:
    """log10 P of every token, from the shortest n-gram up; ``counts`` and ``whole`` (whether the text reaches so far back) by order."""
    with np.errstate(divide="ignore", invalid="ignore"):
        c = counts[0]
        p = (c + 0.5) / (m.total + 0.5 * (m.distinct + 1))
        for o in range(2, len(counts) + 1):
            history = np.concatenate([[c[-1] if o == 2 else 0.0], c[:-1]])
            longer = np.minimum(np.minimum(counts[o - 1], history), c)
            history[~whole[o - 1]] = 0.0
            more = np.minimum(history, history ** m.powers[o - 2])
            p = np.where(history > 0, (longer + more * p) / (history + more), p)
            c = longer
        return np.log10(np.minimum(p, 1.0))


def _log_probabilities(m: Model, grams: list[np.ndarray], word_levels: np.ndarray) -> np.ndarray:
    """log10 P of every token by the filter alone: for models whose n-grams it holds all."""
    longer = [VALUE[np.where(codes < FOUND, codes, 0)] for codes, _ in _codes(m, grams, word_levels)]
    return _smoothed(m, [VALUE[word_levels], *longer], [key != 0 for key in grams])


# A list for an owner (o: its order), or the record of a task's texts (o: RECORD).
RECORD = 1 << 30
_ASKED_DDL = "block long, o int, owner int, keys binary, doc_id array<long>, size array<long>, known array<long>, base array<double>, score array<double>, codes array<binary>"
_LISTS = ["doc_id", "size", "known", "base", "score", "codes"]
_ASKED = pa.schema([
    ("block", pa.int64()), ("o", pa.int32()), ("owner", pa.int32()), ("keys", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())),
    ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("codes", pa.list_(pa.binary())),
])


def _base(m: Model, c: np.ndarray) -> np.ndarray:
    return np.log10((c + 0.5) / (m.total + 0.5 * (m.distinct + 1)))


def _lists(block: int, o: int, keys: np.ndarray, owner_bits: int):
    """Sorted keys as a list for each of their owners."""
    if len(keys):
        owners = (keys >> U((64 if o == 1 else 48) - owner_bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, owners[1:] != owners[:-1])), len(keys))
        packed, none = [_pack(keys[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], [None] * (len(cuts) - 1)
        yield as_batch(_ASKED, [block] * len(none), [o] * len(none), owners[cuts[:-1]], packed, *[none] * len(_LISTS))


def _ask(batches, sent_model):
    m: Model = sent_model.value
    splitter, block = Splitter(SPACE), TaskContext.get().partitionId() << 33
    held, size = [], 0
    for batch in small_batches(batches, "text"):
        held.append((*_tokens(splitter, batch.column("text")), batch.column("doc_id").to_pylist()))
        size += len(held[-1][0])
        if size >= ASKED:
            yield from _ask_block(m, block, held)
            held, size, block = [], 0, block + 1
    if held:
        yield from _ask_block(m, block, held)


def _ask_block(m: Model, block: int, held: list[tuple]):
    """The lists and the record of some texts."""
    before = np.cumsum([0, *(len(tokens) for tokens, _, _ in held)])
    tokens, first = np.concatenate([x[0] for x in held]), np.concatenate([x[1] + at for x, at in zip(held, before, strict=False)])
    ids = [i for x in held for i in x[2]]
    grams = _grams(tokens, first, len(m.floors))
    words, back = np.unique(tokens, return_inverse=True)
    # exact counts: of the head from its table, 0 where the filter holds all words and not this one, else to be asked for
    head, head_counts = m.head
    at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
    in_head = head[at] == words if len(head) else np.zeros(len(words), bool)
    count = np.where(in_head, head_counts[at] if len(head) else 0, 0)
    levels = np.searchsorted(LEAST, count, "right")
    levels = np.where(levels >= m.floors[0], levels, np.where(in_head, FOUND + count, 0))
    levels[~in_head] = read_levels(m.held, words[~in_head] >> U(16), m.floors[0])
    open_ = ~in_head & ((levels > 0) | (m.floors[0] > 1))
    base = np.add.reduceat(np.where(open_, 0.0, _base(m, count))[back], first)
    known = np.add.reduceat((count > 0).astype(np.int64)[back], first)
    places = np.where(open_, np.cumsum(open_), 0)  # from 1 on
    yield from _lists(block, 1, words[open_], m.owner_bits)
    codes, score = [places[back]], np.zeros(len(first))
    if max(m.floors) > 1:
        codes.append(levels[back])
        for o, (code, asked) in enumerate(_codes(m, grams, levels[back], open_[back] if m.floors[0] > 1 else None), 2):
            yield from _lists(block, o, asked, m.owner_bits)
            codes.append(code)
    else:
        score = np.add.reduceat(_log_probabilities(m, grams, levels[back]), first)
    sizes = np.diff(np.append(first, len(tokens)))
    record = [[ids], [sizes.tolist()], [known.tolist()], [base.tolist()], [score.tolist()], [[_plain(x) for x in codes]]]
    yield as_batch(_ASKED, [block], [RECORD], [None], [None], *record)


_ANSWERS = pa.schema([("block", pa.int64()), ("o", pa.int32()), ("owner", pa.int32()), ("counts", pa.binary())])
_ANSWERS_DDL = "block long, o int, owner int, counts binary"


def _answer(own: pa.Table, asked: pa.Table) -> pa.Table:
    """The exact counts of an owner to every list that asks for them."""
    held = {o: (_unpacked(keys), np.append(_opened(counts), 0).astype(np.int64)) for o, keys, counts in zip(*(own.column(c).to_pylist() for c in ("o", "keys", "counts")), strict=True)}
    answers = []
    for o, packed in zip(asked.column("o").to_pylist(), asked.column("keys").to_pylist(), strict=True):
        keys, counts = held.get(o, (np.empty(0, U), np.zeros(1, np.int64)))
        wanted = _unpacked(packed)
        place = np.searchsorted(keys, wanted)
        if len(keys):
            place = np.where(keys[np.minimum(place, len(keys) - 1)] == wanted, place, len(keys))
        answers.append(_plain(counts[place]))
    columns = [asked.column(c).combine_chunks() for c in ("block", "o", "owner")]
    return pa.Table.from_arrays([*columns, pa.array(answers, pa.binary())], schema=_ANSWERS)


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_DDL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _finish(record: pa.Table, answers: pa.Table, m: Model) -> pa.Table:
    """Scores of the texts of a record, with the answers to its lists."""
    lists: dict[int, list] = {}
    # by owner, so in the order of the keys
    answers = answers.sort_by([("o", "ascending"), ("owner", "ascending")])
    for o, counts in zip(answers.column("o").to_pylist(), answers.column("counts").to_pylist(), strict=True):
        lists.setdefault(o, []).append(_opened(counts))
    exact = {o: np.concatenate(x).astype(np.int64) for o, x in lists.items()}
    return pa.Table.from_batches([as_batch(_SCORED, *_scores(m, row, exact)) for row in record.to_pylist()], _SCORED)


def _scores(m: Model, row: dict, exact: dict[int, np.ndarray]):
    none = np.zeros(0, np.int64)
    sizes = np.array(row["size"], np.int64)
    first = np.cumsum(sizes) - sizes
    codes = [_opened(x).astype(np.int64) for x in row["codes"]]
    rest, count = codes[0] > 0, np.append(0, exact.get(1, none))[codes[0]]
    known = np.array(row["known"], np.int64) + np.add.reduceat((count > 0).astype(np.int64), first)
    base = np.array(row["base"]) + np.add.reduceat(np.where(rest, _base(m, count), 0.0), first)
    score = np.array(row["score"])
    if len(codes) > 1:
        held = np.where(codes[1] < FOUND, VALUE[np.minimum(codes[1], len(LEAST))], codes[1] - FOUND)
        counts = [np.where((codes[1] == 0) & rest, count, held)]
        counts += [np.concatenate([VALUE, np.zeros(FOUND - len(VALUE)), exact.get(o, none)])[code] for o, code in enumerate(codes[2:], 2)]
        place = np.arange(len(rest)) - np.repeat(first, sizes)
        score = np.add.reduceat(_smoothed(m, counts, [place >= o - 2 for o in range(1, len(counts) + 1)]), first)
    return row["doc_id"], sizes, known, base, score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Where n-grams are asked of their owners, ``docs`` is read once for each of ``PARTS``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = PARTS if max(model.floors) > 1 else 1
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    light = Model(**(model.__dict__ | {"grams": None}))
    bare = Model(**(light.__dict__ | {"held": None, "head": None}))
    orders = [o for o, floor in enumerate(model.floors, 1) if o == 1 or floor > 1]
    own = model.grams.where(F.col("o").isin(orders)).select("owner", "o", "keys", "counts").groupBy("owner")
    scored = []
    with sent(spark, light) as held:
        for k in range(parts):
            rows = docs.where(part == k) if parts > 1 else docs
            asked = _in_buckets(rows.transform(light_batches).mapInArrow(lambda b: _ask(b, held), _ASKED_DDL), "asked", "block")
            lists = asked.where(F.col("o") < RECORD).select("owner", "block", "o", "keys").groupBy("owner")
            answers = own.cogroup(lists).applyInArrow(_answer, _ANSWERS_DDL).groupBy("block")
            records = asked.where(F.col("o") == RECORD).select("block", *_LISTS).groupBy("block")
            with freed(spark):
                scored.append(staged(records.cogroup(answers).applyInArrow(lambda r, a: _finish(r, a, bare), _SCORED_DDL), "scored"))
            discard(asked)
    out = reduce(DataFrame.unionByName, scored)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null without an id."""
    return F.crc32(doc_id.cast("string")) % folds
