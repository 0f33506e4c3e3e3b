"""Connected components of links kept as a table, by alternating large and small stars.

Every round is two aggregations and two joins over the links, and an aggregation
that tells whether they are settled; nothing is collected, and each round's links
are written to the shared folder.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, discard, light_batches, staged


CHUNK = 1 << 18  # links that one task contracts at a time
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def root_of(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(p, p)
    return x


def forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int] | None = None) -> np.ndarray:
    """Indices of links that join two trees, taken in order (union-find over the given integer nodes).

    ``parent`` may have the trees of earlier links, and gets those of these.
    """
    parent = {} if parent is None else parent
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root_of(parent, x), root_of(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _contracted(batches, chunk: int):
    """Each node of some ``chunk`` links with the least node that these links join it to."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= chunk:
            yield _rooted(held)
            held, count = [], 0
    if count:
        yield _rooted(held)


def _rooted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    parent: dict[int, int] = {}
    for batch in batches:
        for x, y in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            x, y = root_of(parent, x), root_of(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(x, r) for x in list(parent) if (r := root_of(parent, x)) != x]
    nodes, roots = zip(*found, strict=True) if found else ((), ())
    return as_batch(_LINK, nodes, roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select("b", "a").toDF("a", "b")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link to a lesser node, which has none: then all are stars around their least nodes."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(links.select("b", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("ends")).where("down > 1 or (down = 1 and ends > 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """``links(a long, b long)`` to ``(node long, root long)``: each linked node with the least node of its component.

    Tasks contract their own links to stars first, so only what joins stars of
    several tasks needs rounds.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    # contracted after the shuffle, so that no task runs two Python workers
    links = staged(links.distinct().transform(light_batches).mapInArrow(partial(_contracted, chunk=chunk), "a long, b long"), "links")
    for _ in range(most_rounds):
        if _settled(links):
            break
        before, links = links, staged(_star(_star(links, True), False), "links")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(links.select("b", "b").distinct())
