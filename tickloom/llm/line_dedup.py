"""Lines that repeat across documents, found with two Bloom filters.

One filter holds hashes of line keys seen once, the other those seen again (from
another document).  Tasks fill both, and merging two tasks' filters moves what
both had seen once into the second, so the second never misses a repeat.  Lines
that it rules out stay without moving; only suspects are shuffled.  The exact
step groups suspects by the key itself and keeps the smallest document id of
keys that really occur in two documents.

A key is the line without ASCII white space at both ends and with A-Z lowered.
Keys shorter than ``least`` code points never repeat.

Which documents lose a line is again a Bloom filter, over their ids: only texts
that it holds are shuffled to meet their dropped lines, and all others stay.

Defined cases: a null or empty text is one empty line; a document that repeats a
key keeps all of its own copies if it is the first to hold it and loses all
otherwise; repeated rows (same id) count as one document; rows without an id
come after all others; texts of any length are handled in time linear in their
lines; columns of any name are kept.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import as_batch, ddl_of, discard, fresh, light_batches, plain_names, quoted, sent, small_batches, spread_join, staged, texts_of

BYTES_A_LINE = 64  # guessed, for the size of the filters
LAST = (1 << 63) - 1  # stands for a missing id, after all others


def line_keys(text: bytes, least: int) -> list[tuple[int, bytes]]:
    """Numbers and keys of the lines that can repeat."""
    found = []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip()
        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
            found.append((i, key.lower()))
    return found


def _hashes(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _fill(batches, least: int, bits: int):
    pair = bloom.Pair(bits)
    for batch in small_batches(batches, "text"):
        keys = [_hashes({k for _, k in line_keys(t, least)}) for t in texts_of(batch.column("text"))]
        pair.add(np.concatenate(keys))
    yield pair.segments()


_SUSPECT = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("at", pa.list_(pa.int32()))])
_SUSPECT_DDL = "key binary, doc_id long, mark long, at array<int>"


def _suspects(batches, least: int, twice):
    """A row per document and key that the second filter may hold."""
    for batch in small_batches(batches, "text"):
        keys, ids, marks, at = [], [], [], []
        for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), texts_of(batch.column("text")), strict=True):
            lines: dict[bytes, list[int]] = {}
            for i, key in line_keys(text, least):
                lines.setdefault(key, []).append(i)
            if lines:
                may = bloom.contains(twice.value, _hashes(lines))
                for (key, i), m in zip(lines.items(), may.tolist(), strict=True):
                    if m:
                        keys.append(key)
                        ids.append(doc_id)
                        marks.append(mark)
                        at.append(i)
        yield as_batch(_SUSPECT, keys, ids, marks, at)


def _without(batches, text_col: str, drop_col: str):
    """Cut the lines whose numbers ``drop_col`` lists (null: none), and count them."""
    for batch in small_batches(batches, text_col):
        texts, dropped = [], []
        for text, drop in zip(texts_of(batch.column(text_col)), batch.column(drop_col).to_pylist(), strict=True):
            drop = set(drop or ())
            texts.append(b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in drop).decode() if drop else None)
            dropped.append(len(drop))
        cut = pa.array(texts, pa.string())
        kept = batch.column(text_col).cast(pa.string())
        columns = {n: batch.column(n) for n in batch.schema.names} | {text_col: pc.if_else(cut.is_valid(), cut, kept), drop_col: pa.array(dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines cut from ``text_col``, and the columns ``n_lines`` (before) and ``n_dropped``.

    An input's own columns of these two names are replaced.
    """
    docs, spark = docs.drop("n_lines", "n_dropped"), docs.sparkSession
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plain = docs.select(number.alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark"))
    # about as many keys as lines; a wrong guess costs suspects, never results
    lines = plain.select(F.sum(F.coalesce(F.octet_length("text") / BYTES_A_LINE, F.lit(0)) + 1)).first()[0] or 0
    bits = bloom.bits_for(int(lines))
    twice = bloom.gathered(plain.select("text").transform(light_batches).mapInArrow(partial(_fill, least=least, bits=bits), "seg int, once binary, twice binary"), "twice", bits)
    with sent(spark, twice) as held:
        suspects = staged(plain.transform(light_batches).mapInArrow(partial(_suspects, least=least, twice=held), _SUSPECT_DDL), "lines")
    repeated = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    repeated = staged(repeated.where("first < last").select("key", "first", "times"), "repeated")
    drops = spread_join(suspects, repeated, "key", ["doc_id", "mark"]).where("doc_id > first").groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("at")).alias("at"))
    drops = staged(drops, "drops")
    discard(suspects)
    discard(repeated)

    losing = spark.sparkContext.broadcast(bloom.of_longs(drops.select("doc_id"), drops.count()))  # read when the result is

    @F.pandas_udf("boolean")
    def may_lose(ids: pd.Series) -> pd.Series:
        return pd.Series(bloom.contains(losing.value, ids.to_numpy().astype(np.int64).view(np.uint64)))

    names = [*docs.columns, "n_lines", "n_dropped"]
    own_id, own_mark, drop = fresh(names, "_id", "_mark", "_drop")
    n_lines = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    counted = docs.withColumns({"n_lines": n_lines.cast("long"), own_id: number}).transform(light_batches)
    clean = counted.where(~may_lose(own_id)).withColumn("n_dropped", F.lit(0).cast("long"))
    drops = drops.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("at").alias(drop))
    held = counted.where(may_lose(own_id)).withColumn(own_mark, mark).join(drops, [own_id, own_mark], "left").select(*quoted(names[:-1]), drop)
    held = held.toDF(*plain_names(held.columns)).transform(light_batches)
    ddl = ddl_of(held.schema[:-1]) + f", {drop} bigint"
    held = held.mapInArrow(partial(_without, text_col=text_col, drop_col=drop), ddl).toDF(*names)
    return clean.select(*quoted(names)).union(held.select(*quoted(names)))
