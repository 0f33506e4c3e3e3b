"""Versioned commits in a folder that all of a cluster sees.

A version is one small JSON file that names the data it stands for.  It is
written whole under another name and then given its own, unless that is taken:
by a hard link on a local disk, else by a rename, which file systems like HDFS
refuse atomically where the name exists (a store without atomic rename needs one
writer at a time).  So nobody sees half a version, and of two writers that build
on the same version one fails.  Data files are never changed.

A commit can carry the name of a batch.  Names are kept as one small marker file
each, so looking one up costs the same after a million batches; a writer that
dies between commit and marker leaves that to the next one, which marks the
newest version's batch before it does anything else.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import SparkSession

SUFFIX = ".commit"


class Versions:
    """The commit files under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._copy = jvm.org.apache.commons.io.IOUtils
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:012d}{SUFFIX}"

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """All versions that have a file, ascending."""
        where = self._path(self.folder)
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[: -len(SUFFIX)]) for n in names if n.endswith(SUFFIX) and n[: -len(SUFFIX)].isdigit())

    def says(self, version: int) -> dict | None:
        """What a version says; None where its file is gone or torn."""
        path = self._path(self._name(version))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._copy.toString(stream, self._charset))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest number and what the newest readable version says; 0 and nothing before the first."""
        numbers = self.numbers()
        for n in reversed(numbers):
            if (found := self.says(n)) is not None:
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), {}

    def commit(self, version: int, says: dict, batch: str | None = None) -> None:
        """Make ``version``; FileExistsError if another writer has made it already."""
        self._mark(self.latest()[1].get("batch"))
        aside = f"{self.folder}/{uuid.uuid4().hex}.tmp"
        self._write(aside, json.dumps(says | ({} if batch is None else {"batch": batch})))
        try:
            self._publish(aside, self._name(version))
        finally:
            self._fs.delete(self._path(aside), False)
        self._mark(batch)

    def _publish(self, aside: str, name: str) -> None:
        old, new = self._path(aside), self._path(name)
        if self._fs.getUri().getScheme() == "file":
            os.link(old.toUri().getPath(), new.toUri().getPath())
        elif self._fs.exists(new) or not self._fs.rename(old, new):
            raise FileExistsError(f"{name} exists")

    def _marker(self, batch: str) -> str:
        return f"{self.folder}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _mark(self, batch: str | None) -> None:
        if batch is not None and not self._fs.exists(self._path(self._marker(batch))):
            self._write(self._marker(batch), batch)

    def known(self, batch: str) -> bool:
        """Whether a batch of this name is committed."""
        self._mark(self.latest()[1].get("batch"))
        return self._fs.exists(self._path(self._marker(batch)))

    def forget(self, version: int) -> None:
        """Delete a version's file (its batch stays known)."""
        self._fs.delete(self._path(self._name(version)), False)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
