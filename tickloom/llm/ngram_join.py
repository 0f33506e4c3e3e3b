"""N-gram Jaccard self-join by a blocked sparse product of document by n-gram incidence.

A document's row of the incidence matrix is its set of distinct word n-grams.
Two documents link when their sets' Jaccard similarity reaches the threshold;
links are closed to components and every document is returned with the least
document id of its component.

1. Documents with the same set become one row of the matrix (64-bit xxh3 of the
   sorted 64-bit n-gram hashes, together with the size).
2. N-grams are ordered by how common they are (a count sketch of fixed size over
   all documents), then by hash.  A pair that reaches the threshold t shares one
   of the first ``n - ceil(t n) + 1`` n-grams of both rows, so only these columns
   of the product are multiplied.
3. Columns are cut into blocks of rows; a block pair drops pairs by bounds from
   their sizes and from parity sketches as wide as the set asks for (the sketches'
   distance never exceeds the symmetric difference), and reports only a spanning forest of what
   is left.  Its components hold every true link, so they are safe to cut apart.
4. Inside each such cluster the product is taken over all columns, again by
   pairs of row blocks: overlaps are accumulated per pair, and pairs below the
   size-derived bound are dropped.  Again only a spanning forest leaves a task.
5. Components of the exact links give the result.

Nothing is capped: a column or cluster of any size is split into block pairs.  Its
rows are first multiplied with a few of them, and pairs of rows that this has put
into one component need no block pair: they add nothing to the result.

Defined cases: null or blank texts have an empty set, size 0, and link with
nothing; fewer words than n make one n-gram of the whole sequence; texts of any
length are taken whole; a similarity equal to the threshold links; repeated rows
each come back; rows without an id stay alone unless their set is shared, and an
id that is missing never names a component; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import as_batch, discard, group_bounds, light_batches, runs, sent, small_batches, splitmix, staged, texts_of, without_ids
from tickloom.llm.components import components, forest, root_of

SKETCH = 1 << 18  # counters of the count sketch
PARTS = 64  # pieces that the counters are sent in
LEAST_PARITY = 128  # bits of a parity sketch
COLUMN_BLOCK = 1024  # rows of a column that one task multiplies
CLUSTER_BLOCK = 512  # rows of a cluster that one task multiplies
BLOCK_GRAMS = 1 << 20  # n-grams of a block's rows (8 MB of hashes), about: a block has fewer rows where texts are long
CLUSTER_WEIGHT, COLUMN_WEIGHT = "n", "n div 12"  # of a row: its n-grams; its sketch, which has a 12th of their bytes or less
DENSE_COLUMNS = 2048  # columns of the product that are multiplied as one matrix
MOST_JOINED = 1 << 18  # rows that a task remembers as joined
PIVOTS = 128  # rows of a larger column or cluster that all its rows are multiplied with first, about
MOST_WORDS = 400_000  # word hashes remembered by a worker
SHARED, SHARED_PART = 16, 24  # leading n-grams that linked rows must share: so many, or a 24th of the row
NO_ID = -(1 << 63)  # stands for a missing id in a filter


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Odd multipliers for the words of an n-gram, by place.
_ODD = splitmix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingles(words: list[bytes], n: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    size = len(h) - n + 1
    out = h[:size] * _ODD[0]
    for i in range(1, n):
        out += h[i : i + size] * _ODD[i % len(_ODD)] ^ np.uint64(i)
    out = splitmix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) if len(s) else 0


def _rows(batches, n: int):
    """Per batch: the document ids, texts' n-gram sets and set ids."""
    known = _Words()
    for batch in small_batches(batches, "text"):
        sets = [shingles(t.lower().split(), n, known) for t in texts_of(batch.column("text"))]
        yield batch.column("doc_id"), sets, np.array([_set_id(s) for s in sets], np.int64)


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("parity", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
_FIRST_DDL = "doc_id long, n long, sid long, parity binary, part int, counts binary"


def _parity(s: np.ndarray, num: int, den: int) -> bytes:
    """Each n-gram flips one bit: rows that differ in d n-grams differ in d bits at most.

    Unrelated rows differ in half the bits, so there are at least three times as
    many as the threshold lets rows of this size differ in.  Half as many bits
    are the two halves' exclusive or.
    """
    apart = 2 * len(s) * (den - num) // (den + num)
    bits = max(LEAST_PARITY, 1 << max(0, 3 * apart - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _first_pass(batches, n: int, num: int, den: int):
    counts = np.zeros(SKETCH, np.int64)
    for ids, sets, sids in _rows(batches, n):
        counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        k = len(sets)
        yield as_batch(_FIRST, ids, [len(s) for s in sets], sids, [_parity(s, num, den) for s in sets], pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()))
    z = zstandard.ZstdCompressor(level=1)
    blobs = [z.compress(x.tobytes()) for x in counts.reshape(PARTS, -1)]
    none = lambda t: pa.nulls(PARTS, t)
    yield as_batch(_FIRST, none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), np.arange(PARTS, dtype=np.int32), blobs)


_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _summed(batches):
    z, part, total = zstandard.ZstdDecompressor(), None, None
    for batch in batches:
        for p, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(z.decompress(blob), np.int64)
            if p != part:
                if part is not None:
                    yield as_batch(_COUNTS, [part], [total.tobytes()])
                part, total = p, np.zeros_like(own)
            total = total + own
    if part is not None:
        yield as_batch(_COUNTS, [part], [total.tobytes()])


def common_classes(first: DataFrame) -> np.ndarray:
    """A class per counter: 0 where n-grams are as rare as usual, else the order of magnitude (256 KB in all)."""
    sums = first.where("counts is not null").select("part", "counts").repartition("part").sortWithinPartitions("part").transform(light_batches).mapInArrow(_summed, "part int, counts binary")
    total = np.zeros((PARTS, SKETCH // PARTS), np.int64)
    for part, blob in sums.collect():  # 2 MB whatever the input
        total[part] = np.frombuffer(bytes(blob), np.int64)
    total = total.ravel()
    usual = max(16.0, 3 * float(np.median(total)))
    return np.where(total <= usual, 0, np.clip(np.log2(np.maximum(total, 1)), 1, 62)).astype(np.uint8)


def shared_at_least(n: int, num: int, den: int) -> int:
    """How many leading n-grams a row of size n shares with any partner no larger than it.

    More for larger rows, as more of their n-grams are met elsewhere by chance.
    """
    return min(max(SHARED, n // SHARED_PART), -(-n * num // den))


def prefix_length(n: int, num: int, den: int) -> int:
    """How many leading n-grams of a row of size n are needed for that.

    The shorter prefix of two linked rows misses ``ceil(t n) - shared`` of its
    row's n-grams, and the rows share ``ceil(t n)`` at least.
    """
    return n - -(-n * num // den) + shared_at_least(n, num, den)


_ENTRY = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
_KEYED = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int64())])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _entries(batches, n: int, num: int, den: int, classes: np.ndarray, owners):
    """The leading n-grams of each distinct set, from the document with the least id that has it (and few others)."""
    for batch in small_batches(batches, "text"):
        batch = batch.filter(pa.array(bloom.contains(owners.value, _ids(batch))))
        for _, sets, sids in _rows([batch], n):
            rows = []
            for s, sid in zip(sets, sids.tolist(), strict=True):
                if len(s):
                    order = np.argsort(classes[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
                    rows.append((sid, len(s), s[order[: prefix_length(len(s), num, den)]].tobytes()))
            if rows:
                yield as_batch(_ENTRY, *(list(c) for c in zip(*rows, strict=True)))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)


def _fill(batches, bits: int):
    pair = bloom.Pair(bits)
    for batch in batches:
        if batch.num_rows:
            pair.add(_keys(batch))
    yield pair.segments()


def _met_twice(batches, twice, num: int, den: int):
    """Columns that several rows may share, of rows that have as many of these as any link needs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("n").to_numpy()
        keys, each = _keys(batch), np.array([prefix_length(n, num, den) for n in sizes.tolist()])
        owner = np.repeat(np.arange(len(sizes)), each)
        shared = bloom.contains(twice.value, keys)
        need = np.array([shared_at_least(-(-n * num // den), num, den) for n in sizes.tolist()])
        shared &= (np.bincount(owner[shared], minlength=len(sizes)) >= need)[owner]
        owner = owner[shared]
        yield as_batch(_KEYED, keys[shared].view(np.int64), batch.column("sid").to_numpy()[owner], sizes[owner])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _enough(overlap, n, m, num: int, den: int):
    """Whether overlap / (n + m - overlap) >= num / den, in integers."""
    return (num + den) * overlap >= num * (n + m)


def _column_block(sid: np.ndarray, n: np.ndarray, parity: list[bytes], side: np.ndarray, both_sides: bool, num: int, den: int, joined: dict[int, int] | None = None):
    """Pairs of one column's block pair that the bounds leave, as a spanning forest.

    ``joined`` has the trees that the task's earlier columns have made, and gets
    this column's: rows of near copies meet in most of their columns, and rows of
    one tree need no further pair.
    """
    none, joined = (np.empty(0, np.int64), np.empty(0, np.int64)), {} if joined is None else joined
    tree = np.array([root_of(joined, x) if x in joined else x for x in sid.tolist()], np.int64)
    if (tree == tree[0]).all():
        return none
    order = np.argsort(n, kind="stable")
    sid, n, side, tree = sid[order], n[order], side[order], tree[order]
    width = np.array([len(parity[i]) for i in order]) // 8  # grows with n
    cuts = np.append(np.flatnonzero(np.append(True, width[1:] != width[:-1])), len(n))
    sketch = [np.frombuffer(b"".join(parity[i] for i in order[lo:hi]), np.uint64).reshape(hi - lo, -1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    last = np.searchsorted(n, n * den // num, "right")  # rows that are not too large for row i
    a, b = [], []
    for c, own in enumerate(sketch):
        within = [(own, cuts[c], cuts[c + 1])]
        for e in range(c + 1, len(sketch)):  # wider rows within the size bound, folded to this width
            if cuts[e] < last[cuts[c + 1] - 1]:
                within.append((np.bitwise_xor.reduce(sketch[e].reshape(len(sketch[e]), -1, own.shape[1]), axis=1), cuts[e], cuts[e + 1]))
        for i in range(cuts[c], cuts[c + 1]):
            for rows, begin, end in within:
                lo, hi = max(i + 1, begin), min(int(last[i]), end)
                if lo < hi:
                    apart_yet = tree[lo:hi] != tree[i]
                    if both_sides:
                        apart_yet &= side[lo:hi] != side[i]
                    other = lo + np.flatnonzero(apart_yet)
                    if not len(other):
                        continue
                    apart = np.bitwise_count(own[i - cuts[c]] ^ rows[other - begin]).sum(axis=1, dtype=np.int64)
                    sizes = n[i] + n[other]
                    other = other[_enough((sizes - apart) // 2, sizes, 0, num, den)]
                    if len(other):
                        a.append(np.full(len(other), sid[i]))
                        b.append(sid[other])
    if not a:
        return none
    a, b = np.concatenate(a), np.concatenate(b)
    if len(joined) > MOST_JOINED:
        joined.clear()
    kept = forest(a, b, joined)
    return a[kept], b[kept]


def _block_sides(x: int, y: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a block pair (the same array twice where they are one)."""
    at = np.arange(len(own))
    if x == y:
        return at, at
    return at[own == x], at[own == y]


def _columns(batches, num: int, den: int):
    names, joined = ["key", "x", "y"], {}
    for table in runs(batches, names):
        bounds = group_bounds(table, names)
        x, y, own, sid, n = (table.column(c).to_numpy() for c in ("x", "y", "block", "sid", "n"))
        parity = table.column("parity").to_pylist()
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                found.append(_column_block(sid[lo:hi], n[lo:hi], parity[lo:hi], own[lo:hi], x[lo] != y[lo], num, den, joined))
        if found:
            a, b = (np.concatenate(v) for v in zip(*found, strict=True))
            kept = forest(a, b)
            yield as_batch(_LINK, a[kept], b[kept])


def _product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int):
    """Exact links between two row blocks: the sparse product's overlap counts against the size-derived bound.

    Columns that many of the rows share are multiplied as matrices.
    """
    same = left is right
    rows = left if same else np.concatenate([left, right])
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))
    overlap = np.zeros((len(rows), len(rows)), np.int32)
    held = np.diff(cuts)
    many = held * 8 > len(rows)
    for lo, hi in zip(cuts[:-1][~many & (held > 1)].tolist(), cuts[1:][~many & (held > 1)].tolist(), strict=True):
        o = owner[lo:hi]
        overlap[np.ix_(o, o)] += 1
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), held)
    owner, column = owner[column >= 0], column[column >= 0]
    for at in range(0, int(many.sum()), DENSE_COLUMNS):  # sums of so few ones are exact in single precision
        lo, hi = np.searchsorted(column, (at, at + DENSE_COLUMNS))
        dense = np.zeros((len(rows), DENSE_COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += (dense @ dense.T).astype(np.int32)
    if same:
        i, j = np.triu_indices(len(rows), 1)
    else:
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(left)), np.arange(len(left), len(rows)), indexing="ij"))
    ok = _enough(overlap[i, j].astype(np.int64), sizes[rows[i]], sizes[rows[j]], num, den)
    return rows[i[ok]], rows[j[ok]]


def _clusters(batches, num: int, den: int):
    names = ["root", "x", "y"]
    for table in runs(batches, names):
        bounds = group_bounds(table, names)
        x, y, own, sid = (table.column(c).to_numpy() for c in ("x", "y", "block", "sid"))
        sets = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            left, right = _block_sides(x[lo], y[lo], own[lo:hi])
            if len(left) and len(right) and hi - lo > 1:
                i, j = _product(sets[lo:hi], left, right, num, den)
                a, b = sid[lo:hi][i], sid[lo:hi][j]
                kept = forest(a, b)
                found.append((a[kept], b[kept]))
        if found:
            yield as_batch(_LINK, *(np.concatenate(v) for v in zip(*found, strict=True)))


_SET = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("grams", pa.binary())])


def _sets_of(batches, n: int, wanted):
    known = _Words()
    for batch in small_batches(batches, "text"):
        batch = batch.filter(pa.array(bloom.contains(wanted.value, _ids(batch))))
        sets = [shingles(t.lower().split(), n, known) for t in texts_of(batch.column("text"))]
        yield as_batch(_SET, batch.column("doc_id"), [_set_id(s) for s in sets], [s.tobytes() for s in sets])


def _spread(blocks: str):
    """The block of a row, by its set id."""
    return F.pmod(F.xxhash64("sid", F.lit(7)), F.col(blocks)).cast("int")


def _dealt(marked: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of large groups by pairs of blocks, for all pairs of rows but those with one label.

    Labels with half a block of rows or more get blocks of their own, which are not
    paired with each other; the rest share blocks that meet every block.  A row
    fills ``load`` of the ``BLOCK_GRAMS`` of its block, without that column a
    ``block``-th.
    """
    load = F.col("load") if "load" in marked.columns else F.lit(BLOCK_GRAMS // block)
    parts = marked.groupBy(group, "label").agg(F.sum(load).alias("held"))
    parts = parts.withColumn("part", F.when(F.col("held") * 2 >= BLOCK_GRAMS, F.col("label")))
    sizes = parts.groupBy(group, "part").agg(F.ceil(F.sum("held") / BLOCK_GRAMS).cast("int").alias("blocks"))
    whole = Window.partitionBy(group)
    before = F.sum("blocks").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"start": F.coalesce(before, F.lit(0)).cast("int"), "total": F.sum("blocks").over(whole).cast("int")})
    sizes = sizes.withColumnsRenamed({group: "of", "part": "of_part"})
    deal = parts.join(sizes, (F.col(group) == F.col("of")) & F.col("part").eqNullSafe(F.col("of_part")))
    deal = deal.select("of", F.col("label").alias("of_label"), "part", "blocks", "start", "total")
    rows = marked.join(deal, (F.col(group) == F.col("of")) & F.col("label").eqNullSafe(F.col("of_label")))
    rows = rows.withColumn("block", F.col("start") + _spread("blocks"))
    none = "cast(array() as array<int>)"
    others = f"""if(part is null, sequence(0, total - 1), concat(
        if(start > 0, sequence(0, start - 1), {none}), if(start + blocks < total, sequence(start + blocks, total - 1), {none})))"""
    rows = rows.withColumn("other", F.explode(F.expr(others)))
    return rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})


def _load(weight: str, block: int):
    """What a row fills of the ``BLOCK_GRAMS`` of a block: its weight, a ``block``-th at least."""
    return F.greatest(F.expr(weight), F.lit(BLOCK_GRAMS // block))


def _links(rows: DataFrame, sizes: DataFrame, group: str, block: int, weight: str, attach, work, made: list[DataFrame]) -> DataFrame:
    """``a, b``: links whose components are those of all pairs that ``work`` links inside the groups.

    A group of up to ``block`` rows, fewer if their ``weight`` is large, is one
    block.  In a larger one every row is multiplied with about ``PIVOTS`` of the
    group's rows (a block of them at most) first; rows joined by that have one
    label, and only pairs with two labels, or none, are left for the block pairs.
    ``sizes`` has the groups' ``members`` and their ``filled``, the sum of their
    rows' loads; ``attach`` adds what
    ``work`` needs to the dealt rows.  ``made`` receives the tables that the links
    are read from, for the caller to discard.
    """
    names = [*rows.columns, "block", "x", "y"]
    multiply = lambda dealt: _together(attach(dealt.select(*names)), group).transform(light_batches).mapInArrow(work, "a long, b long")
    zero = F.lit(0)
    alone = rows.join(sizes.where(F.col("filled") <= BLOCK_GRAMS), group).withColumns({"block": zero, "x": zero, "y": zero})
    large = staged(sizes.where(F.col("filled") > BLOCK_GRAMS), "large")
    made.append(large)
    if large.isEmpty():
        return multiply(alone)
    rows = rows.distinct().join(large, group).withColumns({"load": _load(weight, block), "blocks": F.ceil(F.col("filled") / BLOCK_GRAMS).cast("int")})
    rows = staged(rows, "large_rows")
    own = rows.withColumn("block", _spread("blocks")).withColumns({"x": F.lit(-1), "y": F.col("block")})
    pivots = rows.where(F.pmod(F.xxhash64("sid", F.lit(11)), F.greatest(F.ceil(F.col("members") / PIVOTS), F.col("blocks"))) == 0)
    pivots = pivots.withColumns({"block": F.lit(-1), "x": F.lit(-1)}).withColumn("y", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    labels = staged(components(multiply(own.select(*names).union(pivots.select(*names)))).toDF("sid", "label"), "labels")
    made += [rows, labels]
    marked = rows.drop("blocks").join(labels, "sid", "left")
    left = _dealt(marked, group, block)
    return multiply(alone.select(*names).union(left.select(*names))).union(labels.toDF("a", "b"))


def _worth_a_look(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Columns with different rows, unless there are two whose sizes alone rule a link out."""
    filled = F.sum(_load(COLUMN_WEIGHT, COLUMN_BLOCK)).alias("filled")
    found = entries.groupBy("key").agg(F.count("*").alias("members"), filled, F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    return found.where(f"lo <> hi and (members > 2 or {den} * least >= {num} * most)").select("key", "members", "filled")


def _together(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "sid")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents link at ``den * |A & B| >= num * |A | B|``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.
    """
    docs, spark = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), docs.sparkSession
    first = staged(docs.transform(light_batches).mapInArrow(partial(_first_pass, n=n, num=num, den=den), _FIRST_DDL), "sets")
    classes = common_classes(first)
    rows = first.where("counts is null").select("doc_id", "n", "sid", "parity")
    distinct = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("parity").alias("parity"))

    owners = distinct.select(F.coalesce("least", F.lit(NO_ID)).alias("least"))
    with sent(spark, bloom.of_longs(owners, distinct.count())) as held:
        entries = docs.transform(light_batches).mapInArrow(partial(_entries, n=n, num=num, den=den, classes=classes, owners=held), "sid long, n long, keys binary")
        columns = entries = staged(entries, "columns")
    bits = bloom.bits_for(entries.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0, 4)
    twice = bloom.gathered(entries.transform(light_batches).mapInArrow(partial(_fill, bits=bits), "seg int, once binary, twice binary"), "twice", bits)
    with sent(spark, twice) as held:
        shared = entries = staged(entries.transform(light_batches).mapInArrow(partial(_met_twice, twice=held, num=num, den=den), "key long, sid long, n long"), "shared")
    discard(columns)
    # the filter of owners lets a few copies through: one row of a set is enough
    sketched = lambda dealt: dealt.distinct().join(distinct.select("sid", "parity"), "sid")
    made = [shared]
    maybe = components(_links(entries, _worth_a_look(entries, num, den), "key", COLUMN_BLOCK, COLUMN_WEIGHT, sketched, partial(_columns, num=num, den=den), made))
    for table in made:
        discard(table)

    members = staged(maybe.toDF("sid", "root").join(distinct.select("sid", "least", "n"), "sid"), "clusters")
    wanted = bloom.of_longs(members.select(F.coalesce("least", F.lit(NO_ID)).alias("least")), members.count())
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum(_load(CLUSTER_WEIGHT, CLUSTER_BLOCK)).alias("filled")).where("members > 1")
    with sent(spark, wanted) as held:
        grams = docs.transform(light_batches).mapInArrow(partial(_sets_of, n=n, wanted=held), "doc_id long, sid long, grams binary")
        grams = staged(grams.toDF("doc_id", "set", "grams"), "grams")

    def filled(blocks: DataFrame) -> DataFrame:
        found = blocks.join(grams, (F.col("sid") == F.col("set")) & F.col("doc_id").eqNullSafe(F.col("least")))
        return found.select("sid", "root", "block", "x", "y", "grams")

    made = [grams, members]
    found = components(_links(members, sizes, "root", CLUSTER_BLOCK, CLUSTER_WEIGHT, filled, partial(_clusters, num=num, den=den), made)).toDF("sid", "root")
    for table in made:
        discard(table)

    labelled = distinct.select("sid", "least").join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "root").select("sid", "component_id")
    out = rows.select("doc_id", "n", "sid").join(labelled, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id: one document of each group stays, with all its columns.

    Rows without words or without an id stay.
    """
    return without_ids(docs, jaccard_components(docs, n, num, den, id_col, text_col).where("component_id < doc_id").select("doc_id"), id_col)


def one_of_each_source(docs: DataFrame, sources: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies by their texts in ``sources``, for texts that an earlier step has taken lines from.

    Line removal takes from a copy all that it shares with its original, so the
    rest no longer shows whose copy it is.  Groups are those of the rows of
    ``sources`` (same columns); of each group the row of ``docs`` with the least id
    stays.  A row goes only if its text is made of lines of a source text with its
    id, so rows of other origin stay, as do rows without an id.
    """
    groups = jaccard_components(sources, n, num, den, id_col, text_col).select("doc_id", F.col("component_id").alias("group")).distinct()
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    kept = groups.join(ids, "doc_id")
    least = kept.groupBy("group").agg(F.min("doc_id").alias("least"))
    gone = staged(kept.join(least, "group").where("least < doc_id").select("doc_id").distinct(), "copies")
    lines = lambda rows, name: rows.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias(name)).join(gone, "doc_id")
    made = lines(docs, "own").join(lines(sources, "source"), "doc_id").where(F.size(F.array_except("own", "source")) == 0)
    return without_ids(docs, made.select("doc_id"), id_col)
