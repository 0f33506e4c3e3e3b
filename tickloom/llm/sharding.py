"""Shards by size-tiered compaction, with a versioned manifest.

An arrival is written as small immutable Parquet shards and becomes visible with
the manifest version that lists it.  Shards of a similar size are merged into files of
about ``target`` bytes: sorted by size, ``fan_in`` or more shards of which the largest
has at most ``fan_in`` times the bytes of the smallest make a run, wherever their sizes
lie.  Files that have reached half the target are left alone, so a row is rewritten
about once per factor of ``fan_in``, and at most ``fan_in - 1`` small shards stay for
each such factor between ``SMALLEST`` bytes and half the target.  A merge is one Spark job over all groups
of a compaction: every group (less than one and a half targets of shards) goes to
one task, whatever the source or key of its rows.

Merged shards stay on disk, so whoever has opened an older version can go on
reading it.  ``vacuum(keep)`` deletes what only versions before the newest
``keep`` list.

The driver handles one manifest line (some 150 bytes) per shard, about 1 MB for
each TB of data in shards of the target size; compaction takes only the lines of
shards below half the target.

Defined cases: an arrival that was committed before is skipped (a retried batch
changes nothing), and arrivals without a name are one named "none"; rows keep all
columns, nulls, repeated rows and texts of any length as they are; an empty
arrival commits an empty list under its name (``append_by`` has no names to
commit without rows); equal sizes merge in order of their paths; columns of any
name are fine; a manifest without shards reads as an empty table with the given
schema.  A version file that a crash has torn is passed over.
"""

from __future__ import annotations

import bisect
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import fresh
from tickloom.llm.versions import Versions

MANIFEST = "path string, batch string, bytes long, rows long"
SMALLEST = 1 << 16  # bytes; smaller shards count as of this size
MOST_FILES = 50_000  # shards that one merge job reads; a compaction takes as many jobs as it needs


class ShardStore:
    """A table kept as shards under ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, target: int = 128 << 20, fan_in: int = 4):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target, self.fan_in = target, fan_in
        self.versions = Versions(spark, f"{self.path}/versions")

    def manifest(self) -> DataFrame:
        """The shards of the newest version."""
        says = self.versions.latest()[1]
        if not says:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(says["manifest"])

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        paths = [r.path for r in self.manifest().select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _commit(self, version: int, shards: DataFrame, batch: str | None = None, gone: list[str] = ()) -> None:
        where = f"{self.path}/manifests/{version:012d}-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(where)  # one line per shard
        says = {"manifest": where}
        if gone:
            says["gone"] = f"{self.path}/gone/{version:012d}-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(p,) for p in gone], "path string").coalesce(1).write.parquet(says["gone"])
        self.versions.commit(version, says, batch)

    def _files(self, *paths: str) -> DataFrame:
        """Rows of shards; their files through ``metadataColumn``, which no column of the table can hide."""
        return self.spark.read.schema(self.schema).parquet(*paths)

    @staticmethod
    def _file(rows: DataFrame) -> F.Column:
        """The file that a row is read from, as a path (Spark gives it URL-encoded)."""
        return F.url_decode(F.replace(rows.metadataColumn("_metadata")["file_path"], F.lit("+"), F.lit("%2B")))

    def _listed(self, folder: str, batch: str) -> DataFrame:
        """Manifest lines of the files in a folder, with sizes and row counts as Spark reads them."""
        rows = self._files(folder)
        rows = rows.select(self._file(rows).alias("path"), rows.metadataColumn("_metadata")["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return rows.select("path", F.lit(batch).alias("batch"), "bytes", "rows")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Write and commit one arrival; False if it was committed before."""
        if self.versions.known(batch):
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self._columns()).write.option("compression", "zstd").parquet(folder)
        self._arrived(folder, batch)
        return True

    def append_by(self, rows: DataFrame, batch: F.Column) -> list[str]:
        """Write several arrivals in one pass over ``rows`` and commit them one after another, in order of their names."""
        (name,) = fresh(self.schema.names, "_batch")
        named = rows.select(*self._columns(), F.coalesce(batch.cast("string"), F.lit("none")).alias(name))
        new = sorted(r[0] for r in named.select(name).distinct().collect() if not self.versions.known(r[0]))  # one line per arrival
        if not new:
            return []
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        named.where(F.col(name).isin(new)).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        # all arrivals' files are listed in one pass; the driver holds a line per file, as for any commit
        parts: dict[str, list] = {}
        for r in self._listed(folder, "").collect():
            arrival = unquote(r.path.rpartition("/")[0].rpartition(f"{name}=")[2])
            parts.setdefault(arrival, []).append((r.path, arrival, r.bytes, r.rows))
        for arrival in sorted(parts):
            lines = self.spark.createDataFrame(parts[arrival], MANIFEST)
            self._commit(self.versions.latest()[0] + 1, self.manifest().union(lines), arrival)
            self.compact()
        return sorted(parts)

    def _columns(self) -> list[F.Column]:
        return [F.col(f"`{c.replace('`', '``')}`") for c in self.schema.names]

    def _arrived(self, folder: str, batch: str) -> None:
        self._commit(self.versions.latest()[0] + 1, self.manifest().union(self._listed(folder, batch)), batch)
        self.compact()

    def _groups(self) -> list[tuple[str, int]]:
        """Shards of the runs that are long enough, with the numbers of the groups that they merge into."""
        small = self.manifest().where(F.col("bytes") < self.target // 2).select("bytes", "path").collect()
        grouped, number = [], -1
        for run in similar_runs(sorted(map(tuple, small)), self.fan_in):
            held = self.target
            for size, path in run:
                if held >= self.target:
                    number, held = number + 1, 0
                grouped.append((path, number))
                held += size
        return grouped

    def compact(self) -> bool:
        """Merge the runs of similar sizes; True if a new version was committed."""
        version = self.versions.latest()[0]
        grouped = self._groups()
        if not grouped:
            return False
        path, group = fresh(self.schema.names, "_path", "_group")
        merged = None
        for part in _jobs(grouped, MOST_FILES):
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            first = part[0][1]
            places = F.broadcast(self.spark.createDataFrame([(p, g - first) for p, g in part], f"{path} string, {group} int"))  # MOST_FILES lines
            rows = self._files(*[p for p, _ in part])
            rows = rows.select(*self._columns(), self._file(rows).alias(path))
            rows = rows.join(places, path).repartitionById(part[-1][1] - first + 1, F.col(group))
            rows.select(*self._columns()).write.option("compression", "zstd").parquet(folder)
            lines = self._listed(folder, f"merge-{version + 1}")
            merged = lines if merged is None else merged.union(lines)
        gone = [p for p, _ in grouped]
        left = self.manifest().join(self.spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_anti")
        self._commit(version + 1, left.union(merged), gone=gone)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete shards, manifests and versions that none of the newest ``keep`` versions needs; how many shards went."""
        numbers, went = self.versions.numbers(), 0
        oldest = numbers[-max(1, keep)] if len(numbers) >= max(1, keep) else 0
        for n in numbers:
            says = self.versions.says(n) or {}
            # shards that version n replaced are read by versions before n only
            if n <= oldest and "gone" in says and self.versions._fs.exists(self.versions._path(says["gone"])):
                for row in self.spark.read.schema("path string").parquet(says["gone"]).toLocalIterator():
                    self.versions.delete(row.path)
                    went += 1
                self.versions.delete(says["gone"])
            if n < oldest:
                if "manifest" in says:
                    self.versions.delete(says["manifest"])
                self.versions.forget(n)
        return went


def similar_runs(shards: list[tuple[int, str]], fan_in: int) -> list[list[tuple[int, str]]]:
    """Runs of at least ``fan_in`` sorted shards (bytes, path) whose sizes are within a factor of ``fan_in``, from the smallest on."""
    sizes, runs, at = [max(SMALLEST, size) for size, _ in shards], [], 0
    while at < len(shards):
        end = bisect.bisect_right(sizes, sizes[at] * fan_in)
        if end - at >= fan_in:
            runs.append(shards[at:end])
            at = end
        else:
            at += 1
    return runs


def _jobs(grouped: list, most: int) -> list[list]:
    """Whole groups, together at most ``most`` files a job (or one group)."""
    jobs: list[list] = [[]]
    for path, group in grouped:
        if len(jobs[-1]) >= most and jobs[-1][-1][1] != group:
            jobs.append([])
        jobs[-1].append((path, group))
    return jobs
