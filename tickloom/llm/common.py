"""What the corpus operators share: staged tables, Arrow helpers, grouped streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.shared import shared_folder, written as staged

__all__ = ["shared_folder", "staged"]


def discard(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of ``column`` (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by ``keys`` (integer columns).

    Several small groups come in one table; a group is never cut, so memory is
    bounded by one batch plus the largest group, which callers bound by blocks.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held and held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py():
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1])
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start offsets of the groups in a sorted table, with the end as last entry."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def light_batches(df: DataFrame) -> DataFrame:
    """Have Spark send Python few rows and few bytes at a time: whole texts are large, and a worker holds a batch several times over.

    Spark reads these two settings when a plan runs, so they are the session's;
    they bound memory and change no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added to those that ``taken`` (in any letter case) has."""
    taken, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[str]:
    """Column names that Spark takes as they are, whatever they contain."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def ddl_of(schema) -> str:
    """A schema as text, with quoted names."""
    return ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(quoted(schema.names), schema.fields, strict=True))


def plain_names(names: Iterable[str]) -> list[str]:
    """The names, with those that Python functions over batches cannot take replaced by numbered ones (for ``toDF`` there and back)."""
    names = list(names)
    odd = [i for i, n in enumerate(names) if "`" in n or "." in n]
    for i, n in zip(odd, fresh(names, *(f"_c{i}" for i in odd)), strict=True):
        names[i] = n
    return names


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``; rows without an id stay."""
    (name,) = fresh(docs.columns, "_gone")
    gone = gone.toDF(name).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


HOT_KEYS = 4096  # a hot key has more than one of so many parts of the rows, so there are fewer hot keys than this
HOT_ROWS = 1 << 16  # and more rows than these, which any task takes
SALTS = 64


def spread_join(many: DataFrame, few: DataFrame, key: str, deal: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined on ``key`` with ``few``, which has a row for each key and in ``times`` its rows in ``many``; both are staged.

    Rows of hot keys are dealt over partitions by the columns ``deal``, and the row of
    ``few`` goes to each of these.  Hot keys are told by 64-bit hashes, at most
    ``HOT_KEYS`` of them; another key with such a hash is dealt as well.  Null keys match nothing.
    """
    tag = F.xxhash64(key)
    hot = few.where(F.col("times") > max(many.count() / HOT_KEYS, HOT_ROWS)).select(tag.alias("tag")).distinct().collect()
    few = few.drop("times")
    if not hot:
        return many.join(few, key, how)
    is_hot = tag.isin([r.tag for r in hot])
    (salt,) = fresh([*many.columns, *few.columns], "_salt")
    many = many.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*deal), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    few = few.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(few, [key, salt], how).drop(salt)


@contextmanager
def sent(spark: SparkSession, value):
    """A value broadcast to the executors and freed there afterwards: for passes whose result is staged inside."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.unpersist()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (wraps on overflow)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
