"""Corpus operators against brute force on small fixtures, edge cases included."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from tickloom.llm import bloom, bpe, common, components, decontam, exact_dedup, line_dedup, ngram_join, oracle, pii, quality, sharding, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def corpus(seed=0):
    """Copies, near copies, shared lines, blank, null, short and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(3, 120)) for _ in range(60)]
    texts += [texts[0]] * 9 + [texts[1], "", None, " \n\t ", "one", "One two", "one  two", "x" * 30000, prose(rng, 4000)]
    long = prose(rng, 200).split()
    for k in range(25):
        own = list(long)
        for _ in range(k % 6):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [f"{prose(rng, 5)}\n  The Same Long Line of text. \n{prose(rng, 4)}" for _ in range(5)] + ["the same long line OF text.\nthe same long line of text."]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[62]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- shared parts -----------------------------------------------------------------------------------


def test_bloom_has_no_false_negatives_and_finds_repeats(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    held = bloom.of_longs(spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(3), 3000)
    assert bloom.contains(held, keys).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert bloom.contains(held, others).mean() < 0.05
    pair = bloom.Pair(1 << 16)
    pair.add(keys[:100])
    pair.add(keys[50:150])
    assert bloom.contains(pair.twice, keys[50:100]).all() and bloom.contains(pair.twice, keys[100:150]).mean() < 0.1


def test_components_of_a_chain_a_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 501), (501, 500), (7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_chain_that_no_task_sees_whole(spark):
    links = spark.range(2500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(links, chunk=1)  # a batch at a time
    assert found.agg(F.count("*"), F.countDistinct("node"), F.max("root")).first()[:] == (2501, 2501, 0)


# --- 1 sharding -------------------------------------------------------------------------------------


def test_shards_are_merged_and_commits_are_idempotent(spark, docs, rows, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target=1 << 20, fan_in=2)
    for k in range(4):
        part = docs.where(F.col("doc_id") % 4 == k)
        assert store.append(part, f"day{k}") and not store.append(part, f"day{k}")
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    shards = store.manifest().collect()
    assert sum(s.rows for s in shards) == len(rows) and len(shards) < 8
    version, says = store.versions.latest()
    with pytest.raises(FileExistsError):
        store.versions.commit(version, says)
    store.vacuum(keep=1)
    data = {f for _, _, files in os.walk(f"{tmp_path}/s/data") for f in files if f.endswith(".parquet")}
    assert data == {os.path.basename(s.path) for s in shards}  # merged shards are gone
    assert store.read().count() == len(rows) and store.vacuum(keep=1) == 0


def test_open_readers_outlive_a_merge_until_vacuum(spark, docs, rows, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, fan_in=2)
    store.append(docs.coalesce(1), "first")
    before = store.read()
    store.append(docs.coalesce(1), "second")  # merges both
    assert store.manifest().count() == 1 and before.count() == len(rows) and store.read().count() == 2 * len(rows)
    assert store.vacuum(keep=3) == 0 and before.count() == len(rows)
    assert store.vacuum(keep=1) == 2


def test_a_torn_version_does_not_stop_the_store(spark, docs, rows, tmp_path):
    docs = docs.coalesce(1)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema)
    store.append(docs, "a")
    version = store.versions.latest()[0]
    open(store.versions._name(version + 1)[len("file://") :], "w").close()  # a writer that died at once
    assert store.read().count() == len(rows) and store.append(docs, "b") and not store.append(docs, "b")
    assert store.read().count() == 2 * len(rows)
    # a writer that died between its version and its batch's marker
    os.remove(store.versions._marker("b")[len("file://") :])
    assert not store.append(docs, "b")
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    counts = docs.select("source", "lang", "n_chars", F.lit(1).alias("one"))
    rollup.apply("x", token_counts.signed(counts, 1, "v", "one"))
    open(rollup.versions._name(2)[len("file://") :], "w").close()
    assert rollup.apply("y", token_counts.signed(counts, 1, "v", "one")) and not rollup.apply("x", token_counts.signed(counts, 1, "v", "one"))
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == 2 * len(rows)


def test_groups_of_a_merge_stay_near_the_target(spark, tmp_path):
    """One source holds nearly all rows; a task still gets one target's worth of shards."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2000)), "hot" if i % 50 else "x") for i in range(2000)], "doc_id long, text string, source string")
    target = 1 << 18
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target=target, fan_in=4)
    store.append(docs.repartition(60), "all")
    sizes = {s.path: s.bytes for s in store.manifest().collect()}
    assert len(sizes) < 20 and max(sizes.values()) <= 1.6 * target and store.read().count() == 2000


def test_similar_sizes_make_a_run_wherever_they_lie():
    kb = lambda *sizes: [(s << 10, f"p{i}") for i, s in enumerate(sizes)]
    merged = lambda shards, fan_in=4: [[s >> 10 for s, _ in run] for run in sharding.similar_runs(shards, fan_in)]
    assert merged(kb(255, 257), 2) == [[255, 257]] and merged(kb(250, 255, 257, 260)) == [[250, 255, 257, 260]]
    assert merged(kb(97, 109, 123, 520)) == [] and merged(kb(97, 109, 123, 388)) == [[97, 109, 123, 388]]
    assert merged(kb(1, 2, 3, 60)) == [[1, 2, 3, 60]]  # the smallest count as equal
    assert merged(kb(70, 300, 1000, 1001, 1002, 4000, 16000)) == [[300, 1000, 1001, 1002]]
    assert merged(kb(500, 500, 500, 500)) == [[500] * 4] and merged([]) == []
    rng = random.Random(3)
    for _ in range(200):  # sixteen shards under half the target always hold a run
        assert sharding.similar_runs(sorted((int(65536 * 1024 ** rng.random()), str(i)) for i in range(16)), 4)


def test_shards_of_equal_size_merge_in_order_of_their_paths(spark, rows, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, fan_in=3)
    for k in range(7):
        store.append(docs.coalesce(1), f"day{k}")
    shards = store.manifest().collect()
    assert len(shards) < 7 and sum(s.rows for s in shards) == 7 * len(rows) == store.read().count()


def test_shards_of_nothing_and_of_odd_names(spark, empty, docs, rows, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", empty.schema)
    assert store.read().count() == 0 and store.append_by(empty, F.col("lang")) == [] and not store.compact() and store.vacuum() == 0
    assert store.append(empty, "nothing") and not store.append(docs, "nothing") and store.versions.latest()[0] == 1 and store.read().count() == 0
    odd = docs.withColumns({c: F.lit(c) for c in ("_batch", "_path", "_group", "_metadata", "path", "a b`c")})
    store = sharding.ShardStore(spark, f"file://{tmp_path}/odd", odd.schema, fan_in=2)
    names = store.append_by(odd, F.concat(F.coalesce("lang", F.lit("none")), F.lit(" 50% a/b+ü=")))
    assert names == [f"{x} 50% a/b+ü=" for x in ("de", "en", "none")] and store.append_by(odd, F.lit(names[0])) == []
    assert sorted(map(str, store.read().collect())) == sorted(map(str, odd.collect()))


# --- 2 n-gram Jaccard join -----------------------------------------------------------------------------


def brute_components(rows, n, num, den):
    sets = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard_components(docs, rows, n, num, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", block)
    want = brute_components(rows, n, num, 100)
    found = ngram_join.jaccard_components(docs, n, num, 100).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def near_copies(copies: int):
    """Copies of one text with a word or two exchanged, a chain that drifts away from it, and texts of their own."""
    base = [f"w{i}" for i in range(60)]
    chain = [[f"z{i}{j}" if i < j else w for i, w in enumerate(base)] for j in range(1, 12)]
    edited = [[f"y{i}" if j in (i % 60, i * 7 % 60) else w for j, w in enumerate(base)] for i in range(copies)]
    other = [[f"{k}o{i}" for i in range(40)] for k in range(9)]
    return [(i, " ".join(words)) for i, words in enumerate([*chain, *edited, *other])]


@pytest.mark.parametrize("block", [3, 8])
def test_large_groups_are_joined_over_pivots(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    texts = near_copies(50)
    found = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 3, 80, 100)


def test_blocks_of_long_texts_have_fewer_rows(spark, monkeypatch):
    """No task gets more n-grams than a few full blocks, however long a group's texts are, and nothing is lost by it."""

    class MostOf(AccumulatorParam):  # here, so that it travels by value
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300, raising=False)
    texts, most = near_copies(50), spark.sparkContext.accumulator(0, MostOf())

    def measured(batches, num, den, work=ngram_join._clusters):
        def seen():
            held = {}
            for batch in batches:
                for x, y, g in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "grams")), strict=True):
                    held[x, y] = held.get((x, y), 0) + len(g) // 8
                    most.add(held[x, y])
                yield batch

        yield from work(seen(), num, den)

    monkeypatch.setattr(ngram_join, "_clusters", measured)
    found = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 3, 80, 100)
    assert 0 < most.value < 1500  # the group's 61 rows have 3538; rows are dealt by hashes, so blocks differ in size


@pytest.mark.parametrize("same", [True, False])
def test_product_of_shared_and_rare_columns(same):
    """Overlaps are exact where a column is multiplied as part of a matrix and where it is not."""
    rng = np.random.default_rng(3)
    common = rng.permutation(5000)[:2500]
    sets = [np.unique(np.concatenate([common[rng.random(2500) < 0.8], rng.integers(5000, 9000, 300)])).astype(np.uint64) for _ in range(24)]
    left = np.arange(24) if same else np.arange(9)
    right = left if same else np.arange(9, 24)
    pairs = [(a, b) for a in left for b in right if not same or a < b]
    share = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in pairs}
    cut = int(100 * np.median(list(share.values())))
    i, j = ngram_join._product(sets, left, right, cut, 100)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(int(a), int(b)) for (a, b), s in share.items() if 100 * s >= cut}


def test_rows_joined_in_one_column_are_not_compared_in_the_next():
    """Near copies share most of their columns; only the first has their links."""
    rng = np.random.default_rng(4)
    grams = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    parity = [ngram_join._parity(np.append(grams, np.uint64(i)), 80, 100) for i in range(6)]
    sid, n, side, joined = np.arange(6), np.full(6, 401), np.zeros(6), {}
    links = lambda rows: ngram_join._column_block(sid[rows], n[rows], [parity[i] for i in rows], side[rows], False, 80, 100, joined)
    assert len(links(np.arange(5))[0]) == 4
    assert len(links(np.arange(5))[0]) == 0
    assert len(links(np.arange(1, 6))[0]) == 1


def test_rows_of_one_label_are_not_dealt_to_pairs(spark):
    """40 rows with one label, 6 with another, 5 without: every pair of different or no labels meets in one block pair."""
    labels = [1] * 40 + [2] * 6 + [None] * 5
    marked = spark.createDataFrame([(7, i, v) for i, v in enumerate(labels)], "root long, sid long, label long")
    met, rows = {}, ngram_join._dealt(marked, "root", 8).collect()
    for r in rows:
        met.setdefault((r.x, r.y), []).append(r)
    pairs = set()
    for (x, y), group in met.items():
        pairs |= {(a.sid, b.sid) for a in group for b in group if a.sid < b.sid and (x == y or a.block != b.block)}
    different = {(i, j) for i in range(51) for j in range(i + 1, 51) if labels[i] is None or labels[i] != labels[j]}
    assert different <= pairs and not any(labels[i] == labels[j] == 1 for i, j in pairs)
    assert len(rows) < 51 * 5  # all pairs of seven blocks would take 51 * 7


def test_rows_with_sketches_four_times_as_wide_link():
    grams = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 104).astype(np.uint64))
    sets = [grams[:42], grams]  # a similarity of 42 / 104, over 0.4
    parity = [ngram_join._parity(s, 40, 100) for s in sets]
    assert len(parity[1]) == 4 * len(parity[0])
    a, b = ngram_join._column_block(np.array([1, 2]), np.array([42, 104]), parity, np.zeros(2), False, 40, 100)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 2)]


def test_one_of_each_keeps_columns_and_null_ids(spark, empty):
    clash = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "A B c d e f", 3), (4, None, 4)], "doc_id long, text string, sid int")
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns and sorted(r.sid for r in kept.collect()) == [1, 2, 4]
    assert ngram_join.one_of_each(empty).count() == 0 and ngram_join.jaccard_components(empty).count() == 0


# --- 3 byte-level BPE ------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken_and_decodes(spark, docs, rows, empty):
    own = bpe.coder(RANKS, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    odd = ["äöü 中文字 🙂🙂 é", "a" * 3000, " " * 500, "<|endoftext|> it's 12345", "\x00\r\n\t x"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {d: t or "" for d, t, *_ in rows} | {10_000 + i: t for i, t in enumerate(odd)}
    for r in bpe.round_trip(table, RANKS, public_tokenizers.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    there = bpe.encode(table, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode(there, RANKS, public_tokenizers.PATTERN).collect()} == texts
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# --- 4 toxicity and 9 quality -----------------------------------------------------------------------------


def test_toxicity_grades_held_out_documents(spark):
    rng, foul = random.Random(5), ["zorkle", "grubbish", "vexoid", "smirched"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 6 == 0)
        words = prose(rng, rng.randrange(30, 200)).split()
        for _ in range(toxic * max(2, len(words) // rng.choice([15, 25, 40]))):
            words.insert(rng.randrange(len(words)), rng.choice(foul))
        rows.append((i, " ".join(words), i))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (9001, None, 0), (9002, "", 0)], "doc_id long, text string, severity int")
    truth = dict(labels)
    model = toxicity.train(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "severity", "grade", "toxic"]
    by = {r.doc_id: r for r in found.collect()}
    unseen = range(600, 900)
    assert np.mean([by[i].toxic == bool(truth[i]) for i in unseen]) > 0.98 and not by[9001].toxic and not by[9002].toxic
    # denser documents are graded as more severe
    dense = {i: sum(w in foul for w in rows[i][1].split()) / len(rows[i][1].split()) for i in unseen if truth[i]}
    assert np.corrcoef([by[i].severity for i in dense], list(dense.values()))[0, 1] > 0.5
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in by if not by[i].toxic}


def test_toxicity_without_labels(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, none).count() == len(rows)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def test_quality_on_the_held_out_fold(spark, empty):
    rng = random.Random(6)
    good = lambda: ". ".join(prose(rng, rng.randrange(5, 15)).capitalize() for _ in range(rng.randrange(2, 12))) + "."
    junk = lambda: rng.choice([" ".join(["spam"] * rng.randrange(20, 90)), "!!! $$$ ### " * rng.randrange(3, 20), " ".join(w + "***" for w in prose(rng, 40).split())])
    rows = [(i, good() if i % 4 else junk()) for i in range(800)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in range(800)) and found[None].held_out
    assert np.mean([found[i].predicted == int(i % 4 > 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(empty, quality.train(empty, none)).count() == 0


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    model = quality.grow(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=12)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        raw = model.base
        for t in range(12):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.cut[t, node])
            raw += model.leaf[t, node - (2**quality.DEPTH - 1)]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


# --- 5 exact dedup ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_hot_key_are_dealt_and_join_as_before(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    many = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("key"))
    few = many.where("key < 'k7' or key = 'hot'").groupBy("key").agg(F.count("*").alias("times"), F.min("id").alias("least"))
    many, few = common.staged(many, "many"), common.staged(few, "few")
    want = many.join(few.drop("times"), "key", how)
    found = common.spread_join(many, few, "key", ["id"], how)
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        values = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        k, unary, low = exact_dedup.golomb_encode(values, 40)
        assert np.array_equal(exact_dedup.golomb_decode(len(values), k, unary, low), values)


@pytest.mark.parametrize("bits", [48, 6])
def test_exact_groups(docs, rows, empty, bits):
    """With 6 bits nearly every fingerprint is shared by different texts."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    found = exact_dedup.exact_groups(docs, bits=bits).collect()
    want = Counter((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)
    assert Counter(map(tuple, found)) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_null_ids_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "a", "z"), (3, "c", "q"), (5, None, "n"), (6, "", "m")], "doc_id long, text string, sha string")
    found = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[1, sha("a")] == (1, 2, True) and found[None, sha("a")] == (1, 2, False) and found[2, sha("b")] == (2, 1, True) and found[5, sha("")] == (6, 2, False)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(r.sha for r in kept.collect()) == ["m", "q", "x", "y"]


# --- 6 line dedup ---------------------------------------------------------------------------------------------


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or doc_id == min(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 16, None])
def test_dedup_lines(docs, rows, empty, bits, monkeypatch):
    if bits:
        monkeypatch.setattr(bloom, "bits_for", lambda *_: 512)  # a full filter: every line is suspect
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_dedup_lines_without_ids(spark):
    docs = spark.createDataFrame([(None, "a repeated line\nx", 1), (4, "A Repeated Line ", 2)], "doc_id long, text string, n_lines int")
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {None: "x", 4: "A Repeated Line "}


# --- 7 decontamination ------------------------------------------------------------------------------------------


def test_least_edits_equals_dynamic_programming():
    rng = random.Random(8)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontam.least_edits(item, text)[0] == min(row)


def test_leaks_are_found_at_the_target_rate(spark, empty):
    rng = random.Random(9)
    syllables = ["an", "er", "tion", "the", "ing", "ou", "re", "st", "wh", "éa", "ß"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize()
    items = [(i, text(rng.randrange(18, 70))) for i in range(60)] + [(60, None), (61, "short"), (62, "")]
    rows, truth = [], set()
    for d in range(300):
        body, item = text(rng.randrange(20, 300)).split(" "), rng.randrange(60)
        leak = list(items[item][1])
        for _ in range(int(0.1 * len(leak)) if d % 2 else 0):
            p = rng.randrange(len(leak))
            leak[p : p + 1] = rng.choice([[], ["x"], [leak[p], "q"]])
        if d % 3 != 2:
            at = rng.randrange(len(body))
            body[at:at] = ["".join(leak)]
            truth.add((d, item))
        rows.append((d, " \n ".join([" ".join(body[:50]), " ".join(body[50:])]), "i"))
    docs = spark.createDataFrame([*rows, (None, items[0][1], "x"), (900, None, "y"), (901, "", "z")], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark, most_edits=0.12).collect()}
    assert found - truth == {(None, 0)} and len(found & truth) / len(truth) >= 0.95
    assert {x for x in truth if x[0] % 2 == 0} <= found  # exact copies
    kept = decontam.without_leaks(docs, benchmark, most_edits=0.12)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3 - len({d for d, _ in found if d is not None})
    assert decontam.leaks(empty, benchmark).count() == 0 and decontam.leaks(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "most"), [(60, 80), (80, 120), (120, 180), (180, 300)])
def test_leaks_with_all_allowed_edits_are_found_at_each_length(spark, least, most):
    rng = random.Random(least)
    syllables = ["an", "er", "tion", "the", "ing", "ou", "re", "st", "wh", "éa", "ß"]
    words = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(i, words(most)[: rng.randrange(least, most)].rstrip().ljust(least, "x")) for i in range(100)]
    rows = []
    for d in range(400):
        leak = list(items[d % 100][1])
        for _ in range(int(0.15 * len(leak))):
            p = rng.randrange(len(leak))
            leak[p : p + 1] = rng.choice([[], [rng.choice("aeinrst ")], [leak[p], rng.choice("aeinrst ")]])
        rows.append((d, f"{words(20)} {''.join(leak)} {words(20)}"))
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_edits=0.15)
    held = {(r.doc_id, r.item_id) for r in found.collect()}
    assert np.mean([(d, d % 100) in held for d, _ in rows]) >= 0.95


def test_short_items_are_all_found(spark):
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choice(["an", "er", "tion", "the", "ou", "éa", "ß"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(i, words(30)[: 12 + i // 2].strip().ljust(12 + i // 2, "x")) for i in range(100)]  # 12 to 61 characters
    rows = []
    for d in range(400):
        leak = list(items[d % 100][1])
        for _ in range(int(0.15 * len(leak)) if d % 2 else 0):
            p = rng.randrange(len(leak))
            leak[p : p + 1] = rng.choice([[], ["s"], [leak[p], "t"]])
        rows.append((d, f"{words(20)} {''.join(leak)} {words(20)}"))
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_edits=0.15)
    held = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    assert all(held[d, d % 100] == 0 for d in range(0, 400, 2))  # exact copies
    truth = {(d, i) for d, text in rows for i, item in items if decontam.least_edits(decontam.normalised(item.encode()).decode(), decontam.normalised(text.encode()).decode())[0] <= int(0.15 * len(item))}
    assert set(held) <= truth and {x for x in truth if len(items[x[1]][1]) < 60} <= set(held)


# --- 8 personal data -----------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub(r"[^0-9]", "", v)) <= 19 and luhn(re.sub(r"[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub(r"[^0-9]", "", v)) <= 15),
)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, rx, ok in BASE for m in re.finditer(rx, text or "") if ok(m[0])]


def test_personal_data_equals_the_patterns(spark, empty):
    rng = random.Random(10)
    odd = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "é中🙂 4111 1111 1111 1111 and +1 (555) 123-4567 a..b@c-d.e-.f", "4111-1111-1111-1111-", "1" * 3000, "a" * 5000 + "@", "1.1.1." * 500]
    fuzz = ["".join(rng.choice("0123456789.@+- ()ab\né") for _ in range(rng.randrange(80))) for _ in range(400)]
    rows = list(enumerate([*odd, *fuzz]))
    docs = spark.createDataFrame([(i, t, "k") for i, t in [*rows, rows[4]]], "doc_id long, text string, spans string")
    found = pii.digest(pii.sanitise(docs)).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        want = base_spans(dict(rows)[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in want) for n, *_ in BASE]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
    assert pii.digest(pii.sanitise(empty)).count() == 0


def test_revealing_terms_are_marked_and_others_left(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 12, 30) + (f"\nwrite to Quimbly {prose(rng, 2, 30)} at q@host.example.org" if i < 6 else f"\nplain line {i}")) for i in range(80)]
    rows += [(200, rows[0][1]), (201, "Quimbly alone is left")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (*range(6), 200):
        marked = {s.value for s in got[i].spans if s.kind >= len(pii.KINDS)}
        assert "Quimbly" in marked and "Quimbly" not in got[i].sanitised and "[EMAIL]" in got[i].sanitised
    assert got[201].spans == [] and got[201].sanitised == rows[-1][1] and got[50].sanitised == rows[50][1]


def test_terms_of_entities_met_once_or_twice_are_marked(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, 12, 300) for _ in range(6))) for i in range(300)]
    plant = lambda i, *lines: rows.__setitem__(i, (i, "\n".join([rows[i][1], *lines])))
    plant(0, "ask Brindle at x7@one.example.org", *(f"Brindle {prose(rng, 3, 300)}" for _ in range(3)))  # one line with the entity, more in its document
    plant(1, f"Ostwick {prose(rng, 2, 300)} k9@two.example.org")  # two lines in two documents
    plant(2, f"{prose(rng, 2, 300)} Ostwick has k9@two.example.org")
    for i in range(3, 7):  # each once, but one domain
        plant(i, f"Farrowgate {prose(rng, 2, 300)} u{i}@three.example.org")
    plant(7, "mail to t.velmarsh@four.example.org", prose(rng, 4, 300), "Velmarsh will answer")  # a word of the entity
    plant(8, "Solitary words stand by z1@five.example.org")  # once, and nowhere else
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    marked = {i: {s.value for s in r.spans if s.kind >= len(pii.KINDS)} for i, r in got.items()}
    assert "Brindle" in marked[0] and "Velmarsh" in marked[7]
    assert "Ostwick" in marked[1] & marked[2] and all("Farrowgate" in marked[i] for i in range(3, 7))
    assert "Solitary" not in marked[8] and not any(marked[i] for i in range(9, 300))


# --- 10 token counts --------------------------------------------------------------------------------------------------


def test_rollup_of_signed_batches(spark, docs, rows, tmp_path):
    counts = token_counts.document_counts(docs, RANKS, public_tokenizers.PATTERN).persist()
    own = bpe.coder(RANKS, public_tokenizers.PATTERN)
    by = {r.doc_id: r for r in counts.collect()}
    for d, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (by[d].blanks, by[d].words, by[d].bpe) == (len(words), sum(any(c.isalnum() for c in w) for w in words), own.count(text or ""))
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.apply("in", token_counts.signed(counts, 1, "v1", "bpe")) and not rollup.apply("in", token_counts.signed(counts, 1, "v1", "bpe"))
    gone = counts.where("doc_id < 20")
    rollup.apply("out", token_counts.signed(gone, -1, "v1", "bpe"))
    rollup.apply("revise", token_counts.revised(counts.where("doc_id >= 20"), "v1", "bpe", "words"))
    want = defaultdict(lambda: [0, 0, 0])
    for d, text, lang, source, _ in rows:
        if d >= 20:
            for k, v in enumerate((1, by[d].words, len(text or ""))):
                want[source, lang][k] += v
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in rollup.totals().collect()} == dict(want)
    rollup.apply("rest", token_counts.signed(counts.where("doc_id >= 20"), -1, "v1", "words"))
    assert rollup.totals().count() == 0


# --- SQL and pipeline --------------------------------------------------------------------------------------------------


SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_data
def test_queries_against_sql(spark):
    from tickloom.llm import queries

    c = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        found, expected = queries.QUERIES[name](spark, SF), c.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(expected.columns)
        at = [expected.columns.index(x) for x in columns]
        assert Counter(tuple(r[x] for x in columns) for r in found.collect()) == Counter(tuple(r[i] for i in at) for r in expected.fetchall()), name


@needs_data
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept and len(now) > 0.7 * len(kept)
        kept = now
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "line_dedup":
            assert all(key[2] == 0 for key in brute_lines(rows))
        if name == "ngram_jaccard":
            assert all(root == d for d, (_, root) in brute_components(rows, 5, 80, 100).items())
    last = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == kept == {r.doc_id for r in p.run(spark, SF).collect()}
    assert oracle.LINES
