"""Prefix trie of conversations, merged from the partitions' partial tries.

A conversation c is rebuilt as the first h turns of conversation c - c % 5 and its
own turns after its first h, with h = crc32(c) % 9.  A node of the trie is a
distinct sequence of first turns, with the conversations that begin with it.

1. *Order.*  Turns are range-partitioned and sorted by conversation and turn, so a
   conversation of any length may lie over many partitions.  A task numbers the
   turns of each conversation that it holds and keeps a running key of them; what
   comes before a conversation's part in a later partition is added from one row
   per partition.
2. *Keys.*  A sequence's key is a polynomial over its turns' digests modulo two
   primes (122 bits), so the key of a rebuilt sequence is put together from the
   keys of its two pieces, and no turn is gathered twice.
3. *Partial tries.*  Each rebuilt conversation is a row per node.  Tasks combine
   their rows to node tables, which are merged by key in two rounds, first inside
   groups of tasks and then over all: numbers of members and ends are added,
   the least member is kept.  Rows that end at a node form its end list; it is
   digested in ascending order as a stream, so no list is held in memory.
4. *Rollup.*  A node belongs to its least member, and the nodes of a member are the
   lowest part of its path.  Sums go up each path by blocks of ``BLOCK`` nodes and
   then over blocks; what a path sums to counts once more at each higher node that
   the member passes.  So the rollup takes the same number of shuffles however
   deep the trie is.

What nodes say to their members goes by a broadcast for nodes with more than a
``HOT``-th of all rows (so there are at most ``HOT`` of them), and by a join on the
key for the others, where no key has more rows than that.

Defined cases: turns go by number, null first, equal numbers by role and text; a
null role or text is empty; rows without a conversation are left out; repeated
rows are turns like any other; an empty table gives no node; negative ids are
taken as they are (c - c % 5 with the remainder's sign of the dividend); other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, discard, light_batches, small_batches, staged

C = F.col
TURNS, SHARERS = 9, 5  # fixed values of the rebuilding rule: h is below TURNS, SHARERS conversations share a beginning
BLOCK = 1024  # nodes of a path that are summed together
HOT = 4096
GROUPS = 16  # groups of tasks whose node tables are merged first
PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (0x0E1F3C2B5A697887, 0x1B873593CC9E2D51)


# --- keys -----------------------------------------------------------------------------------------------------------


def _digest(role: bytes, text: bytes) -> tuple[int, int]:
    """A turn's value modulo each prime, never 0."""
    whole = xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "little") + role + text)
    return tuple((whole >> (64 * i) & ((1 << 64) - 1)) % (p - 1) + 1 for i, p in enumerate(PRIMES))


def _longer(key: tuple[int, int], turn: tuple[int, int]) -> tuple[int, int]:
    return tuple((k * b + t) % p for k, t, b, p in zip(key, turn, BASES, PRIMES, strict=True))


def joined(key: tuple[int, int], piece: tuple[int, int], turns: int) -> tuple[int, int]:
    """The key of a sequence followed by a piece of so many turns."""
    return tuple((k * pow(b, turns, p) + x) % p for k, x, b, p in zip(key, piece, BASES, PRIMES, strict=True))


def without(key: tuple[int, int], before: tuple[int, int], turns: int) -> tuple[int, int]:
    """The key of the last so many turns of a sequence, what comes before them given."""
    return tuple((k - x * pow(b, turns, p)) % p for k, x, b, p in zip(key, before, BASES, PRIMES, strict=True))


_TURN = pa.schema([("part", pa.int32()), ("conv", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), *((k, pa.int64()) for k in ("k1", "k2", "p1", "p2"))])
_TURN_DDL = "part int, conv long, at long, bytes long, k1 long, k2 long, p1 long, p2 long"


def _numbered(batches):
    """Place, running key and the key before it of every turn, among those of its conversation in this partition."""
    part, conv, at, key = TaskContext.get().partitionId(), None, 0, (0, 0)
    for batch in small_batches(batches, "text"):
        rows = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
            role, text = role.encode(), text.encode()
            if c != conv:
                conv, at, key = c, 0, (0, 0)
            before, key, at = key, _longer(key, _digest(role, text)), at + 1
            rows.append((part, c, at, len(text), *key, *before))
        yield as_batch(_TURN, *(list(x) for x in zip(*rows, strict=True)))


def _continued(batches, before: dict):
    """Places and keys with what the conversation has in earlier partitions."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if found := before.get((r["part"], r["conv"])):
                turns, key = found
                r["k1"], r["k2"] = joined(key, (r["k1"], r["k2"]), r["at"])
                r["p1"], r["p2"] = joined(key, (r["p1"], r["p2"]), r["at"] - 1)
                r["at"] += turns
        yield pa.RecordBatch.from_pylist(rows, schema=_TURN)


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv, at, bytes, k1, k2, p1, p2`` of every turn: its place from 1, its text's bytes, and the keys with and without it.

    Nothing is gathered by conversation.  The driver gets one row for each partition
    that a conversation goes on in, and one for where it begins.
    """
    turns = conversations.select(
        C("conv_id").cast("long").alias("conv"), C("turn").cast("long").alias("turn"), F.coalesce(C("role").cast("string"), F.lit("")).alias("role"), F.coalesce(C("text").cast("string"), F.lit("")).alias("text")
    ).where("conv is not null")
    order = ("conv", F.asc_nulls_first("turn"), "role")
    # a text's beginning keeps the texts' order and is short enough to be sampled
    turns = turns.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    local = staged(turns.select("conv", "role", "text").transform(light_batches).mapInArrow(_numbered, _TURN_DDL), "numbered")
    parts = local.groupBy("part", "conv").agg(F.max_by(F.struct("at", "k1", "k2"), "at").alias("x"))
    several = parts.groupBy("conv").agg(F.count("*").alias("of")).where("of > 1")
    before: dict = {}
    held: dict = {}
    for r in sorted(parts.join(several, "conv").select("conv", "part", "x.*").collect()):
        turns_, key = held.get(r.conv, (0, (0, 0)))
        if turns_:
            before[r.part, r.conv] = (turns_, key)
        held[r.conv] = (turns_ + r.at, joined(key, (r.k1, r.k2), r.at))
    if before:
        # equal turns (same number, role and text) may be cut apart anywhere, as they are alike
        local = local.transform(light_batches).mapInArrow(lambda b: _continued(b, before), _TURN_DDL)
    return local.drop("part")


# --- rebuilt conversations --------------------------------------------------------------------------------------------

_MEMBER = pa.schema([*((n, pa.int64()) for n in ("conv", "depth", "k1", "k2", "p1", "p2", "bytes")), ("last", pa.bool_())])
_MEMBER_DDL = "conv long, depth long, k1 long, k2 long, p1 long, p2 long, bytes long, last boolean"


def _moved(batches):
    """Own turns after the first h, with the keys of the rebuilt sequence."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            begin, cut, after = (r["b1"], r["b2"]), (r["h1"], r["h2"]), r["at"] - r["h"]
            key, before = (joined(begin, without(k, cut, n), n) for k, n in (((r["k1"], r["k2"]), after), ((r["p1"], r["p2"]), after - 1)))
            rows.append((r["conv"], r["shared"] + after, *key, *before, r["bytes"], r["at"] == r["n"]))
        if rows:
            yield as_batch(_MEMBER, *(list(x) for x in zip(*rows, strict=True)))


def _block(place: Column | str) -> Column:
    return F.floor((C(place) if isinstance(place, str) else place) / BLOCK)


def _by_block(per_conv: DataFrame, length: str) -> DataFrame:
    """A conversation's row once for each block of its path, so that joins meet no more than a block's rows under one key."""
    return per_conv.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _block(length))))


def members(turns: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and node that it begins with: ``conv, depth``, the keys of the node and its parent, ``bytes, last``."""
    first = F.when(C("at") < TURNS, F.struct("at", "bytes", "k1", "k2", "p1", "p2"))
    convs = staged(turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("first")), "convs")
    h = F.crc32(C("conv").cast("string")) % TURNS
    paths = convs.select("conv", "n", "first", h.alias("h"), (C("conv") - C("conv") % SHARERS).alias("base"))
    paths = paths.join(convs.select(C("conv").alias("base"), C("first").alias("base_first"), C("n").alias("base_n")), "base", "left")
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    paths = paths.withColumns({"shared": shared, "own": F.greatest(F.lit(0), C("n") - C("h"))})
    none = F.lit(0).cast("long")
    root = paths.select("conv", none.alias("depth"), *(none.alias(k) for k in ("k1", "k2", "p1", "p2", "bytes")), ((C("shared") == 0) & (C("own") == 0)).alias("last"))
    begun = paths.where("shared > 0").select("conv", "shared", "own", F.explode(F.filter("base_first", lambda x: x["at"] <= C("shared"))).alias("x"))
    begun = begun.select("conv", C("x.at").alias("depth"), *(C(f"x.{k}") for k in ("k1", "k2", "p1", "p2", "bytes")), ((C("x.at") == C("shared")) & (C("own") == 0)).alias("last"))
    key_at = lambda first, place, k: F.when(place > 0, F.try_element_at(first, place.cast("int"))[k]).otherwise(none)
    own = paths.where("own > 0").select("conv", "n", "h", "shared", *(key_at(C("base_first"), C("shared"), k).alias(n) for k, n in (("k1", "b1"), ("k2", "b2"))), *(key_at(C("first"), C("h"), k).alias(n) for k, n in (("k1", "h1"), ("k2", "h2"))))
    rows = turns.withColumn("block", _block("at")).join(_by_block(own, "n"), ["conv", "block"]).where("at > h").drop("block")
    rows = rows.transform(light_batches).mapInArrow(_moved, _MEMBER_DDL)
    return root.union(begun).union(rows)


# --- trie -------------------------------------------------------------------------------------------------------------

KEY = ("depth", "k1", "k2")
EMPTY = hashlib.sha256().hexdigest()


def merged(tables: DataFrame, keys: tuple[str, ...], group: Column, *sums: Column) -> DataFrame:
    """Node tables merged by key: those of a group of conversations, then of all groups.

    ``sums`` are aggregates that can be taken again over themselves.
    """
    inner = tables.groupBy(*keys, F.pmod(group, F.lit(GROUPS)).alias("_group")).agg(*sums)
    again = {"sum": F.sum, "min": F.min, "max": F.max}
    return inner.groupBy(*keys).agg(*(again[n.split("_", 1)[0]](n).alias(n) for n in inner.columns if n not in (*keys, "_group")))


_ENDS = pa.schema([*((n, pa.int64()) for n in (*KEY, "conv")), ("ids", pa.string())])
_ENDS_DDL = "depth long, k1 long, k2 long, conv long, ids string"
_DIGEST = pa.schema([*((n, pa.int64()) for n in KEY), ("ends_sha256", pa.string())])
_DIGEST_DDL = "depth long, k1 long, k2 long, ends_sha256 string"


def _listed(batches):
    """Runs of a node's ends, in order, as text: at most a batch's rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in (*KEY, "conv")]
        change = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]]))
        at = np.append(np.flatnonzero(change), batch.num_rows)
        ids = [",".join(map(str, columns[3][a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield as_batch(_ENDS, *(c[at[:-1]] for c in columns), ids)


def _digested(batches):
    """SHA-256 of each node's runs, joined by commas."""
    held, sha = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
            if key != held:
                if held is not None:
                    done.append((*held, sha.hexdigest()))
                held, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield as_batch(_DIGEST, *(list(x) for x in zip(*done, strict=True)))
    if held is not None:
        yield as_batch(_DIGEST, *([x] for x in (*held, sha.hexdigest())))


def ends(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of the members that end at each node, ascending.  A long list is written out by many tasks and only hashed by one."""
    lists = rows.where("last").select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    lists = lists.transform(light_batches).mapInArrow(_listed, _ENDS_DDL)
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "conv").drop("conv").transform(light_batches).mapInArrow(_digested, _DIGEST_DDL)


def nodes(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    turns = staged(ordered(conversations), "turns")
    rows = staged(members(turns), "members")
    total = rows.count()
    group = F.xxhash64("conv")
    trie = merged(rows, (*KEY, "p1", "p2"), group, F.min("conv").alias("min_conv"), F.sum(F.lit(1)).alias("sum_convs"), F.sum(C("last").cast("long")).alias("sum_ends"))
    trie = staged(trie, "trie")

    # nodes tell their members
    said = trie.select(*KEY, "min_conv", "sum_convs", "sum_ends")
    hot = F.broadcast(said.where(C("sum_convs") * HOT > total))
    told = rows.join(hot, list(KEY), "left")
    cold = told.where("min_conv is null").select(*rows.columns).join(said.where(C("sum_convs") * HOT <= total), list(KEY))
    told = told.where("min_conv is not null").select(*cold.columns).union(cold)
    told = told.withColumns({"mine": C("conv") == C("min_conv"), "saved": (C("sum_convs") - 1) * C("bytes"), "leaf": C("last") & (C("sum_convs") == C("sum_ends"))})
    told = staged(told.withColumn("block", _block("depth")), "told")

    # up each path: the nodes that belong to a conversation are the lowest of its path
    own = told.where("mine")
    blocks = own.groupBy("conv", "block").agg(F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("saved").over(below), F.lit(0)).alias("below"))
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("path", F.sum("saved").over(inside)).join(blocks, ["conv", "block"]).withColumn("path", C("path") + C("below"))

    # what a path sums to counts at every higher node that its conversation passes
    path = told.groupBy("conv").agg(
        F.sum(F.when(C("mine"), C("saved"))).alias("path_saved"), F.coalesce(F.sum(F.when(C("mine") & C("leaf"), 1)), F.lit(0)).alias("path_leaves"), F.min(F.when(C("mine"), C("depth"))).alias("top"),
        F.max(F.when(~C("mine"), F.struct("depth", "min_conv")))["min_conv"].alias("above"), F.max("depth").alias("length"),
    )
    path = staged(_by_block(path, "length"), "paths")
    up = told.join(path.where("path_saved > 0 or path_leaves > 0"), ["conv", "block"])
    up = merged(up, KEY, group, F.sum("path_leaves").alias("sum_leaves"), F.sum(F.when(C("mine"), 0).otherwise(C("path_saved"))).alias("sum_saved"))
    children = trie.where("depth > 0").groupBy((C("depth") - 1).alias("depth"), C("p1").alias("k1"), C("p2").alias("k2")).agg(F.count("*").alias("n_children"))

    out = own.join(path.select("conv", "block", "top", "above"), ["conv", "block"]).join(up, list(KEY), "left").join(children, list(KEY), "left").join(ends(rows), list(KEY), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parent = F.when(C("depth") == 0, F.lit(None)).when(C("depth") == C("top"), C("above")).otherwise(C("conv"))
    out = out.select(
        C("conv").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), C("sum_convs").cast("long").alias("n_convs"), zero(C("n_children")).alias("n_children"), zero(C("sum_leaves")).alias("n_leaves"),
        (C("path") + zero(C("sum_saved"))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = staged(out, "nodes")
    for table in (turns, rows, trie, told, path):
        discard(table)
    return out
