"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each task takes a 48-bit fingerprint of every whole text, sorts the distinct
   ones by owner (their leading bits) and sends each owner its sorted list,
   Golomb-Rice coded.  A fingerprint that a task met again is marked locally.
2. An owner decodes the lists it got, finds fingerprints that more than one list
   holds, and answers each list with a bitmap.
3. Rows whose bit is set are suspects.  Only their texts are shuffled, and equal
   texts are found by comparing the bytes (grouping by the text itself, with
   partial aggregation first, so a text that a third of all rows share arrives as
   one row per task).

Defined cases: a null text counts as empty; of equal texts the row with the
largest id stays; repeated rows (same id and text) are all counted in
``group_size`` and share one decision; a missing id never wins over a present
one, and rows that have no id are kept only where no copy has one; texts of any
length are compared whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import as_batch, discard, fresh, light_batches, sent, small_batches, spread_join, staged, texts_of

BITS = 48  # of a fingerprint
LIST = 1 << 18  # rows that a task holds before it sends its lists


def golomb_encode(values: np.ndarray, bits: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct integers below ``2**bits`` as Rice parameter, unary quotients and binary remainders of their gaps."""
    n = len(values)
    k = max(0, bits - n.bit_length()) if n else 0
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    remainders = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + remainders, dtype=np.uint64)


_LISTS = pa.schema(
    [("part", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("low", pa.binary()),
     ("ids", pa.list_(pa.int64())), ("slots", pa.binary()), ("again", pa.binary()), ("shas", pa.binary())]
)
_LISTS_DDL = "part long, owner int, n int, k int, unary binary, low binary, ids array<long>, slots binary, again binary, shas binary"


def _lists(part: int, owner_bits: int, bits: int, ids: pa.Array, prints: np.ndarray, shas: np.ndarray) -> pa.RecordBatch:
    """One row per owner: the coded list, and beside it (kept, not sent) the rows' ids, slots in the list and digests."""
    order = np.argsort(prints, kind="stable")
    prints, shas, ids = prints[order], shas[order], ids.take(pa.array(order))
    owners = (prints >> np.uint64(bits - owner_bits)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, owners[1:] != owners[:-1])), len(prints))
    rows = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, slots, times = np.unique(prints[lo:hi], return_inverse=True, return_counts=True)
        k, unary, low = golomb_encode(own & np.uint64((1 << (bits - owner_bits)) - 1), bits - owner_bits)
        again = np.packbits((times > 1).astype(np.uint8)).tobytes()
        rows.append((part, int(owners[lo]), len(own), k, unary, low, ids.slice(lo, hi - lo).to_pylist(), slots.astype("<u4").tobytes(), again, shas[lo:hi].tobytes()))
    return as_batch(_LISTS, *(list(c) for c in zip(*rows, strict=True)))


def _send(batches, owner_bits: int, bits: int):
    part = TaskContext.get().partitionId() << 24
    ids, prints, shas, held = [], [], [], 0
    for batch in small_batches(batches, "text"):
        texts = texts_of(batch.column("text"))
        ids.append(batch.column("doc_id"))
        prints.append(np.array([xxhash.xxh3_64_intdigest(t) >> (64 - bits) for t in texts], np.uint64))
        shas.append(np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), np.uint8).reshape(-1, 32))
        held += len(texts)
        if held >= LIST:
            yield _lists(part, owner_bits, bits, pa.concat_arrays(ids), np.concatenate(prints), np.concatenate(shas))
            part, ids, prints, shas, held = part + 1, [], [], [], 0
    if held:
        yield _lists(part, owner_bits, bits, pa.concat_arrays(ids), np.concatenate(prints), np.concatenate(shas))


_ANSWER = pa.schema([("part", pa.int64()), ("owner", pa.int32()), ("elsewhere", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """What an owner answers: for each list, which of its fingerprints another list holds too."""
    lists = [golomb_decode(n, k, u, w) for n, k, u, w in zip(*(table.column(c).to_pylist() for c in ("n", "k", "unary", "low")), strict=True)]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[times > 1]
    found = [np.packbits(np.isin(x, shared, assume_unique=True).astype(np.uint8)).tobytes() for x in lists]
    return pa.Table.from_arrays([table.column("part").combine_chunks(), table.column("owner").combine_chunks(), pa.array(found, pa.binary())], schema=_ANSWER)


_ROWS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("suspect", pa.bool_())])


def _opened(batches):
    for batch in batches:
        for ids, slots, again, elsewhere, shas in zip(*(batch.column(c).to_pylist() for c in ("ids", "slots", "again", "elsewhere", "shas")), strict=True):
            marked = np.unpackbits(np.frombuffer(again, np.uint8)) | np.unpackbits(np.frombuffer(elsewhere, np.uint8))
            shas = [shas[i : i + 32] for i in range(0, len(shas), 32)]
            yield as_batch(_ROWS, ids, shas, marked[np.frombuffer(slots, "<u4")].astype(bool))


def _texts_of_suspects(batches, wanted):
    missing = -1
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("doc_id").fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(bloom.contains(wanted.value, keys)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; of equal texts the largest id stays.

    ``bits`` is the width of a fingerprint: fewer make more suspects, and the same result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # owners grow with the input, so that an owner's fingerprints always fit one task
    owner_bits = min(24, bits, max(5, (docs.count() >> 18).bit_length()))
    lists = staged(docs.transform(light_batches).mapInArrow(partial(_send, owner_bits=owner_bits, bits=bits), _LISTS_DDL), "lists")
    answers = lists.select("part", "owner", "n", "k", "unary", "low").groupBy("owner").applyInArrow(_answer, "part long, owner int, elsewhere binary")
    mine = lists.select("part", "owner", "ids", "slots", "again", "shas").join(answers, ["part", "owner"])
    rows = staged(mine.transform(light_batches).mapInArrow(_opened, "doc_id long, sha binary, suspect boolean"), "prints")

    suspects = rows.where("suspect").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))
    with sent(docs.sparkSession, bloom.of_longs(suspects, suspects.count())) as wanted:
        texts = docs.transform(light_batches).mapInArrow(partial(_texts_of_suspects, wanted=wanted), "doc_id long, text string")
        groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
        # the digest only addresses the verified group from here on
        groups = staged(groups.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size", F.col("group_size").alias("times")), "groups")
    discard(lists)
    single = rows.where("not suspect").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    several = spread_join(rows.where("suspect"), groups, "sha", ["doc_id"], "left")
    several = several.select("doc_id", "sha", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    out = single.union(several)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row's id of each group of equal texts, all columns kept."""
    id_name, sha_name = fresh(docs.columns, "_gone", "_sha")
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name)).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & (sha == F.col(sha_name)), "left_anti")
