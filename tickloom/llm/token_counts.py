"""Token counts as rollups that signed deltas keep up to date.

Totals by source, language and tokenizer version are sums, so a batch needs only
its own rows: an insert adds a document's counts, a delete takes them away, and a
revised count does both.  A batch is summed per key first (partial sums before
the shuffle, so a source with a third of all rows arrives as one row per task),
then added to the totals, and both the totals and the batch's name are committed
as one version.  A batch whose name is committed already changes nothing, so a
retry is safe.

Defined cases: null sources and languages are keys of their own; null counts and
texts count as 0 tokens; keys whose sums are all 0 disappear; repeated rows count
as often as they come; an empty batch is only recorded; other columns are ignored,
whatever their names; long texts are counted whole.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe
from tickloom.llm.common import light_batches, small_batches, texts_of
from tickloom.llm.versions import Versions

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def signed(counts: DataFrame, sign: int, tokenizer: str, tokens: str) -> DataFrame:
    """Per-document counts as deltas: +1 for an insert, -1 for a delete."""
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) * sign
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), value(tokens).alias("n_tokens"), value("n_chars").alias("n_chars"))


def revised(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Deltas that replace the count ``old`` by ``new`` where they differ."""
    changed = counts.where(~F.col(old).eqNullSafe(F.col(new)))
    return signed(changed, -1, tokenizer, old).union(signed(changed, 1, tokenizer, new))


class Rollup:
    """Totals under ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def totals(self) -> DataFrame:
        says = self.versions.latest()[1]
        if not says:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(says["totals"])

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas; False if it was applied before."""
        if self.versions.known(batch):
            return False
        version = self.versions.latest()[0]
        added = self.totals().union(deltas.select(*KEYS, *SUMS)).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        where = f"{self.path}/totals/{version + 1:012d}-{uuid.uuid4().hex}"
        added.where(" or ".join(f"{c} <> 0" for c in SUMS)).write.parquet(where)
        self.versions.commit(version + 1, {"totals": where}, batch)
        return True


def _count(batches, ranks_file: str, pattern: str):
    own, known = bpe.coder(ranks_file, pattern), {}
    for batch in small_batches(batches, "text"):
        tokens = []
        for text in texts_of(batch.column("text")):
            total = 0
            for piece in own.split(text.decode()):
                n = known.get(piece)
                if n is None:
                    n = len(own.encode_piece(piece.encode()))
                    if len(piece) <= bpe.LONG_PIECE:
                        if len(known) >= bpe.MOST_PIECES:
                            known.clear()
                        known[piece] = n
                total += n
            tokens.append(total)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(tokens, np.int64))], names=[*batch.schema.names[:-1], "bpe"])


def document_counts(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``doc_id, source, lang, n_chars, blanks, words, bpe`` of every row.

    ``blanks`` counts runs of anything but white space, ``words`` only those with
    a letter or digit, ``bpe`` the ids of the byte-level merges.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                        F.length(text).cast("long").alias("n_chars"), count(r"[^\x20\x09-\x0D]+").alias("blanks"),
                        count(r"[^\x20\x09-\x0D\p{L}\p{N}]*+[\p{L}\p{N}][^\x20\x09-\x0D]*+").alias("words"), text.alias("text"))
    ddl = "doc_id long, source string, lang string, n_chars long, blanks long, words long, bpe long"
    return plain.transform(light_batches).mapInArrow(partial(_count, ranks_file=ranks_file, pattern=pattern), ddl)
