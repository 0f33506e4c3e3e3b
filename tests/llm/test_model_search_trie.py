"""The language model, ranked search and the conversation trie against brute force, edge cases included."""

import hashlib
import math

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_corpus_operators import prose
from test_edge_cases import CLASHES, SF, needs_data, plain
from tickloom.llm import lexical, lm, queries, trie, words

DOCS = "doc_id long, text string"


def awkward_texts(seed=0):
    rng = random.Random(seed)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(200_000))  # a text over 1 MB
    texts = [prose(rng, rng.randrange(1, 60), 60) for _ in range(60)] + [None, "", " \n", "One", "one ONE one", "é É ü_x-1", "x" * 100_000, long]
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[3], rows[60], (None, texts[5]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASHES if c not in df.columns})


# --- words ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [7, 64, 1 << 16])
def test_words_are_told_apart_whatever_the_piece(piece, monkeypatch):
    monkeypatch.setattr(words, "PIECE", piece)
    rng = random.Random(2)
    texts = [None, "", " ", "a", "A b  c\n", "é x1 É", "x" * 200] + ["".join(rng.choices("abcABC \n\té0-_.", k=rng.randrange(80))) for _ in range(200)]
    for splitter, pattern in ((words.Splitter(words.SPACE), rb"[^\x20\x09-\x0D]+"), (words.Splitter(words.NO_TERM), rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        hashes, sizes = splitter.words(pa.array(["dropped", *texts]).slice(1))
        want = [re.findall(pattern, (t or "").encode().lower()) for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        known = {}
        for word, h in zip([w for x in want for w in x], hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h == splitter.of(word.decode())
        assert len(set(known.values())) == len(known)


# --- 11 language model ----------------------------------------------------------------------------------------------


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def exact(train, texts):
    c = Counter(w for t in train for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t))
    return n, [(len(tokens_of(t)), sum(c[w] > 0 for w in tokens_of(t)), base(t)) for t in texts]


def test_levels_are_exact_first_and_a_quarter_apart_later():
    assert lm.LEAST[:9].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 10] and lm.VALUE[:9].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 8.5]
    assert (lm.LEAST[8:] / lm.LEAST[7:-1] < 1.2500001).all()


def test_packed_lists_come_back():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (lm._unpacked(lm._pack(x)) == x).all() and (lm._opened(lm._plain(x)) == x).all() and len(lm._unpacked(lm._pack(x[:0]))) == 0


def test_a_filter_never_reads_a_level_too_low():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 4000).astype(np.uint64))
    levels, each = rng.integers(1, 20, len(keys)), 1 << 10
    held = np.zeros(lm.SEGMENTS * each // 8, np.uint8)
    for seg in range(lm.SEGMENTS):
        own = (keys >> np.uint64(40)) == seg
        held[seg * each // 8 : (seg + 1) * each // 8] = np.frombuffer(lm._segment(keys[own], levels[own], 1, each), np.uint8)
    read = lm.read_levels(held, keys, 1)
    assert (read >= levels).all() and (read > levels).mean() < 0.25  # a filter over a third as full again as in production
    assert (lm.read_levels(held, rng.integers(0, 1 << 48, 4000).astype(np.uint64), 1) > 0).mean() < 0.25


@pytest.mark.parametrize("most", [1 << 27, 1 << 13])
def test_scores_of_counts(spark, rows, docs, most):
    train = docs.where(F.col("doc_id") % 3 > 0)
    model = lm.train(train, most_bytes=most)
    assert (max(model.floors) > 1) == (most < 1 << 20) and model.floors == sorted(model.floors)
    n, want = exact([t for i, t in rows if i is not None and i % 3 > 0], [t for _, t in rows])
    found = lm.score(docs, model).collect()
    assert all(r.train_tokens == n for r in found)
    key = lambda i, a, b, s: (i is None, i or 0, a, b, round(s, 6 if abs(s) < 1e5 else 3))
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found) == sorted(key(i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert all(r.score < 0 for r in found)
    by_id = {r.doc_id: r for r in found}
    # a training text is likelier under its own n-grams
    assert by_id[7].score > by_id[7].base_score or most < 1 << 20


def test_probabilities_of_a_history_sum_to_one_at_most(spark):
    rng = random.Random(5)
    texts = [prose(rng, 40, 30) for _ in range(200)]
    model = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS))
    splitter = words.Splitter(words.SPACE)
    vocabulary = [f"w{i}" for i in range(30)]
    # after "w1 w2" each word, and the end
    sums = 0.0
    for w in [*vocabulary, ""]:
        tokens, first = lm._tokens(splitter, pa.array([f"w1 w2 {w}"]))
        levels = lm.read_levels(model.held, tokens >> np.uint64(16), model.floors[0])
        sums += 10 ** lm._log_probabilities(model, lm._grams(tokens, first, 3), levels)[2]
    assert 0.9 < sums < 1.05


def witten_bell(train, texts, powers, order=3):
    """Scores under exact counts."""
    grams = lambda t: [((b"",) + tuple(tokens_of(t)), i, o) for i in range(1, len(tokens_of(t)) + 1) for o in range(1, order + 1) if o <= i + 1]
    c = Counter(x[i - o + 1 : i + 1] for t in train for x, i, o in grams(t))
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    out = []
    for t in texts:
        p = {}
        for x, i, o in grams(t):
            if o == 1:
                p[i] = (c[x[i : i + 1]] + 0.5) / (n + 0.5 * (v + 1))
            elif h := c[x[i - o + 1 : i]]:
                more = min(h, h ** powers[o - 2])
                p[i] = (c[x[i - o + 1 : i + 1]] + more * p[i]) / (h + more)
        out.append(sum(math.log10(min(1.0, q)) for q in p.values()))
    return out


@pytest.mark.parametrize("each", [1 << 40, 40, 10])
def test_n_grams_under_the_floor_keep_their_counts(spark, monkeypatch, each):
    monkeypatch.setattr(lm, "BITS_EACH", each)
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 60), 80) for _ in range(120)] + [None, "", "One", "one ONE one"]
    have = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    model = lm.train(have.where("doc_id % 4 > 0"), most_bytes=1 << 13)
    assert model.floors[2] > 1 and bool(model.held.any()) == (each < 1 << 40)
    want = witten_bell([t for i, t in enumerate(texts) if i % 4 > 0], texts, model.powers)
    found = {r.doc_id: r for r in lm.score(have, model).collect()}
    assert len(found) == len(texts)
    if each == 1 << 40:  # the filter holds nothing: every count is asked for
        assert [found[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-9)
    # otherwise the filter's own errors remain: steps of a quarter, and levels too high
    assert sum(abs(found[i].score - w) for i, w in enumerate(want)) < 0.01 * -sum(want)


def test_only_the_head_of_the_words_comes_to_the_driver(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 100)
    model = lm.train(docs)
    assert 0 < len(model.head[0]) <= 100 and len(model.head[0]) == len(set(model.head[0].tolist()))
    n, want = exact([t for _, t in rows], [t for _, t in rows])
    found = sorted((r.n_tokens, r.n_known, round(r.base_score, 3)) for r in lm.score(docs, model).collect())
    assert found == sorted((a, b, round(c, 3)) for a, b, c in want)


def test_floors_rise_with_the_order_until_the_keys_fit():
    numbers = np.array([[100, 50, 10, 0], [1000, 100, 10, 0], [3000, 50, 1, 0]])
    assert lm.floors_for(numbers, 1e6) == [1, 1, 1]
    floors = lm.floors_for(numbers, 600)
    assert floors == sorted(floors) and floors[0] == 1 and floors[2] == 2
    assert lm.floors_for(numbers, 0)[2] == 4


def test_model_on_nothing_and_with_other_columns(spark, docs):
    empty = lm.train(docs.limit(0))
    assert {r.base_score for r in lm.score(docs, empty).collect()} == {0.0} and lm.score(docs.limit(0), empty).count() == 0
    assert plain(lm.score(clashing(docs), lm.train(clashing(docs))).collect()) == plain(lm.score(docs, lm.train(docs)).collect())


@needs_data
def test_op11_query(spark):
    have = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    n, want = exact([d.text for d in have if not held(d.doc_id)], [d.text for d in have])
    found = {r.doc_id: r for r in queries.QUERIES["op11_lm_scoring"](spark, SF).collect()}
    assert len(found) == len(have)
    for d, (tokens, known, base) in zip(have, want, strict=True):
        r = found[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d.doc_id), tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held out, all together


# --- 12 ranked search -----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(rows, items, k):
    tf = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    texts = defaultdict(set)
    for i, t in items:
        texts[i].add(t)
    for item, of in texts.items():
        q, scored = Counter(w for t in of for w in TERM.findall((t or "").translate(LOWER))), []
        for i, c in tf:
            m = 25 + (75 * sum(c.values()) * docs) // max(1, total)
            s = sum(n * math.floor(1000 * math.log((2 * docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, n in q.items() if c[w])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_ranks(spark, rows, docs, k):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(1, 12), 80)) for i in range(12)] + [(20, None), (21, "!?"), (22, "nowhere"), (23, "w1 w1 W1 é"), (24, rows[3][1]), (25, "w1"), (25, "w2"), (25, "w1")]
    benchmark = spark.createDataFrame([*items, (None, "w1")], "item_id long, text string")
    found = lexical.search(docs, benchmark, k)
    assert Counter(map(tuple, found.collect())) == brute_ranks(rows, items, k)
    if k == 3:
        assert plain(lexical.search(clashing(docs), clashing(benchmark), k).collect()) == plain(found.collect())
        assert lexical.search(docs.limit(0), benchmark).count() == 0 and lexical.search(docs, benchmark.limit(0)).count() == 0


# --- 13 trie --------------------------------------------------------------------------------------------------------


def brute_nodes(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        s = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append((c, d == len(s)))
    for k in members:
        if k:
            children[k[:-1]].append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
    least = lambda k: min(c for c, _ in members[k])
    digest = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return Counter((least(k), len(k), least(k[:-1]) if k else None, len(m), len(children[k]), leaves[k], saved[k], digest(m)) for k, m in members.items())


def chats(seed=0, convs=80):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", rng.choice(["a", "b", "", "é"]) if t > 0 else "hello"))
    rows += [(200, None, None, None), (200, None, "user", "x"), (200, 1, "user", "x"), (200, 1, "user", "x"), (201, 5, "user", "only"), (-7, 0, "user", "hello"), (-5, 0, "user", "hello"), (None, 1, "user", "x")]
    rows += [(310 + i, t, "user", "the same") for i in range(30) for t in range(12)]  # copies that end together
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(3000)]  # a third of all turns and more
    rng.shuffle(rows)
    return rows


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1024, 16])
def test_nodes(spark, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = chats()
    table = spark.createDataFrame(rows, CHATS).repartition(6)
    assert Counter(map(tuple, trie.nodes(table).collect())) == brute_nodes(rows)


def test_a_long_conversation_lies_over_partitions(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(2000)] + [(6, t, "user", f"t{t % 3}") for t in range(50)]
    turns = trie.ordered(spark.createDataFrame(rows, CHATS).repartition(8)).where("conv = 5").orderBy("at").collect()
    key = (0, 0)
    for at, r in enumerate(turns, 1):
        assert (r.at, (r.p1, r.p2)) == (at, key)
        key = trie._longer(key, trie._digest(b"user", f"t{at - 1}".encode()))
        assert (r.k1, r.k2) == key


def test_trie_of_nothing_and_with_other_columns(spark):
    rows = chats(1, 20)[:400]
    table = spark.createDataFrame(rows, CHATS)
    assert trie.nodes(table.limit(0)).count() == 0 and trie.nodes(table.where("conv_id is null")).count() == 0
    assert plain(trie.nodes(clashing(table)).collect()) == plain(trie.nodes(table).collect()) == brute_nodes(rows)


def test_keys_put_together_from_pieces():
    turns = [trie._digest(b"r", bytes([i])) for i in range(9)]
    key = lambda ts: reduce(trie._longer, ts, (0, 0))
    assert trie.joined(key(turns[:4]), key(turns[4:]), 5) == key(turns) and trie.without(key(turns), key(turns[:4]), 5) == key(turns[4:])

