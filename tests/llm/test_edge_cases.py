"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, and each query on the smallest tables."""

import hashlib
import os
import random
import time
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from test_corpus_operators import BASE, base_spans, brute_components, brute_lines, prose
from tickloom.llm import bpe, decontam, exact_dedup, line_dedup, ngram_join, pii, quality, queries, sharding, token_counts, toxicity
from tickloom.llm.common import fresh

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CLASHES = (
    "_id", "_mark", "_held", "_drop", "_gone", "_sha", "_severity", "severity", "grade", "toxic", "_path", "_batch", "_group", "_metadata", "key", "sid", "mark", "at", "n", "root", "block", "ids", "sha",
    "item_id", "edits", "spans", "base", "terms", "kind", "score", "held_out", "n_lines", "n_dropped", "n_tokens", "bpe", "words", "blanks", "part", "line", "copies", "component_id", "keep_id", "a b", "a.b", "a`b",
)
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def awkward_rows():
    rng = random.Random(21)
    item = prose(rng, 30)
    long = "\n".join(f"{prose(rng, 12)} mail{i}@host.example.org" for i in range(800)) + f"\n{item}\na line that several documents hold"
    texts = [None, "", " \n ", "x", item, f"{prose(rng, 20)} {item} {prose(rng, 20)}", long, long, "a line that several documents hold", f"{prose(rng, 40)}\nA line that several documents hold\n", prose(rng, 60), prose(rng, 60)]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[7], rows[0], (None, texts[10], None, None, None)], item


@pytest.fixture(scope="module")
def awkward(spark):
    rows, item = awkward_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, int(i in (4, 5))) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "")], "item_id long, text string")
    return docs, labels, benchmark


def applications(spark, docs, labels, benchmark, folder):
    def shards(d):
        store = sharding.ShardStore(spark, f"file://{folder}/{uuid.uuid4().hex}", d.schema, fan_in=2)
        store.append_by(d, F.col("lang"))
        return store.read().select("doc_id", "text", "lang", "source", "n_chars")

    own = ["doc_id", "text", "lang", "source", "n_chars"]
    return {
        "op1": shards,
        "op2": ngram_join.jaccard_components,
        "op2 one of each": lambda d: ngram_join.one_of_each(d).select(*own),
        "op2 by source": lambda d: ngram_join.one_of_each_source(d, d).select(*own),
        "op3": lambda d: bpe.round_trip(d, RANKS, PATTERN),
        "op3 ids": lambda d: bpe.encode(d, RANKS, PATTERN, carry=["lang"]).toDF("doc_id", "lang", "i"),
        "op4": lambda d: toxicity.score(d, toxicity.train(d, labels)).select("doc_id", "severity", "grade", "toxic"),
        "op4 rest": lambda d: toxicity.without_toxic(d, labels).select(*own),
        "op5": exact_dedup.exact_groups,
        "op5 rest": lambda d: exact_dedup.without_copies(d).select(*own),
        "op6": lambda d: line_dedup.dedup_lines(d).select(*own, "n_lines", "n_dropped"),
        "op7": lambda d: decontam.leaks(d, benchmark),
        "op7 rest": lambda d: decontam.without_leaks(d, benchmark).select(*own),
        "op8": lambda d: pii.digest(pii.sanitise(d)),
        "op9": lambda d: quality.score(d, quality.train(d, labels)),
        "op10": lambda d: token_counts.document_counts(d, RANKS, PATTERN),
    }


NAMES = ["op1", "op2", "op2 one of each", "op2 by source", "op3", "op3 ids", "op4", "op4 rest", "op5", "op5 rest", "op6", "op7", "op7 rest", "op8", "op9", "op10"]


def plain(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing_and_empty_tables_give_none(spark, awkward, tmp_path, name):
    docs, labels, benchmark = awkward
    apply = applications(spark, docs, labels, benchmark, tmp_path)[name]
    found = plain(apply(docs).collect())
    clashing = docs.withColumns({c: F.lit(c) for c in CLASHES})
    assert plain(apply(clashing).collect()) == found
    assert apply(docs.limit(0)).count() == 0
    if name in ("op3", "op4", "op5", "op6", "op8", "op9", "op10"):
        assert sum(found.values()) == docs.count()  # a row for every row, repeated and null ones too


def test_results_on_awkward_rows(spark, awkward):
    docs, _, benchmark = awkward
    rows = awkward_rows()[0]
    have = [r for r in rows if r[0] is not None]
    want = brute_components(have, 5, 80, 100)
    found = ngram_join.jaccard_components(docs).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(have)
    lines = line_dedup.dedup_lines(docs).where("doc_id is not null").collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in lines) == brute_lines(have)
    leaks = {(r.doc_id, r.item_id): r.edits for r in decontam.leaks(docs, benchmark).collect()}
    assert leaks == {(d, i): 0 for d in (4, 5, 6, 7) for i in (1, 2)}
    for r in pii.digest(pii.sanitise(docs)).collect():
        spans = base_spans(dict((d, t) for d, t, *_ in rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_scores_do_not_depend_on_the_batch():
    rng, known = random.Random(4), toxicity._Features()
    texts = [prose(rng, rng.randrange(1, 300)).encode() for _ in range(300)]
    weights = np.random.default_rng(1).normal(size=toxicity.WIDTH)
    together = toxicity._dot(*toxicity.features(texts, known), weights)
    alone = [toxicity._dot(*toxicity.features([t], known), weights)[0] for t in texts]
    assert together.tolist() == alone


def test_a_severity_equal_to_the_cut_is_toxic(spark):
    model = toxicity.Model(np.zeros(toxicity.WIDTH, np.float32), np.array([0.0, 1.0, 2.0]), 0.0)
    model.cut = float(toxicity.severity(model, np.zeros(1))[0])
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.toxic for r in toxicity.score(docs, model).collect()] == [True, True]


def test_long_pieces_equal_tiktoken():
    own = bpe.coder(RANKS, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    for piece in ("".join(rng.choices("abcdeinrst", k=3 * bpe.STRETCH + 17)), "ab" * bpe.STRETCH, "é" * (bpe.STRETCH + 5)):
        assert own.encode_piece(piece.encode()) == reference.encode_ordinary(piece)


def test_many_matches_take_little_time(spark):
    text = " ".join(f"user{i}@host{i % 97}.example.org" for i in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.with_base(docs.limit(1).withColumn("text", F.lit("a@b.c"))).collect()
    began = time.time()
    assert pii.with_base(docs).select(F.size("base")).first()[0] == 40_000
    assert time.time() - began < 15  # seconds; a quadratic way takes minutes


def test_overlapping_spans_leave_nothing_of_either(spark):
    text = "see 1.2.3.4@x.yz and b@9.8.7.6 or é1.2.3.4x"
    r = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] == base_spans(text)
    assert not any(c.isdigit() or c == "@" for c in r.sanitised)
    raw = text.encode()
    assert all(raw[s["at"] : s["to"]].decode() == text[s.start : s.end] == s.value for s in r.spans)


def test_fresh_names():
    assert fresh(["a", "B_"], "a", "b", "b", "A") == ["a_", "b", "b__", "A__"]


# --- the queries, with production parameters, on the smallest tables -------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").collect()
    return {n: read(n) for n in ("documents", "labels", "benchmark")}


@needs_data
def test_op3_query_equals_tiktoken(spark, tables):
    own = bpe.coder(RANKS, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.QUERIES["op3_bpe_round_trip"](spark, SF).collect()}
    assert len(found) == len(tables["documents"])
    for d in tables["documents"]:
        ids = np.array(reference.encode_ordinary(d.text or ""), "<u4")
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


@needs_data
def test_op4_and_op9_queries_agree_with_labels(spark, tables):
    toxic = {r.doc_id: r for r in queries.QUERIES["op4_toxicity"](spark, SF).collect()}
    good = {r.doc_id: r for r in queries.QUERIES["op9_quality"](spark, SF).collect()}
    assert set(toxic) == set(good) == {d.doc_id for d in tables["documents"]}
    labels = [x for x in tables["labels"] if x.doc_id in toxic]
    assert np.mean([toxic[x.doc_id].toxic == bool(x.toxic) for x in labels]) > 0.9
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert all(good[x.doc_id].held_out for x in held) and np.mean([good[x.doc_id].predicted == x.quality for x in held]) > 0.75  # 19 documents


@needs_data
def test_op7_query_equals_a_scan_of_all_windows(spark, tables):
    found = {(r.doc_id, r.item_id): (r.edits, r.allowed) for r in queries.QUERIES["op7_decontaminate"](spark, SF).collect()}
    items = {b.item_id: decontam.normalised((b.text or "").encode()).decode() for b in tables["benchmark"]}
    docs = {d.doc_id: decontam.normalised((d.text or "").encode()).decode() for d in tables["documents"]}
    truth = {}
    some = sorted(docs, key=lambda d: (not any(x[0] == d for x in found), d))[:60]  # all with leaks, and others
    for d in some:
        for i, item in items.items():
            if item:
                edits, allowed = decontam.least_edits(item, docs[d])[0], int(0.15 * len(item))
                if edits <= allowed:
                    truth[d, i] = (edits, allowed)
    assert set(found) <= set(truth) and all(found[k] == truth[k] for k in found)
    assert len(found) >= 0.95 * len(truth)


@needs_data
def test_op8_query_has_all_base_spans(spark, tables):
    found = {r.doc_id: r for r in queries.QUERIES["op8_pii"](spark, SF).collect()}
    for d in tables["documents"]:
        want = base_spans(d.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = found[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in want) for n, *_ in BASE]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


@needs_data
@pytest.mark.skipif(not os.path.isdir(SF.replace("sf0.001", "sf0.01")), reason="test tables are not here")
def test_op8_query_adds_spans_by_terms_and_filters_on_it_end(spark):
    found = queries.QUERIES["op8_pii"](spark, SF.replace("sf0.001", "sf0.01"))
    began = time.time()
    assert found.where("spans rlike 'generalised|removed'").count() > 0
    for c in found.columns:
        assert found.where(F.col(c).cast("string") != "?").count() == found.count()
    assert time.time() - began < 60


def test_a_domain_that_very_many_addresses_share(spark):
    """Terms reach texts through their parts: neither entities nor texts are multiplied with the domain's terms."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Farrowgate Velmarsh mail u"), F.col("id"), F.lit("@big.example.org\nplain words "), F.col("id") % 997).alias("text"))
    began = time.time()
    found = pii.sanitise(docs)
    assert found.where(F.size("spans") < 1).count() == 0 and found.where("sanitised like '%@%'").count() == 0
    assert time.time() - began < 120


@needs_data
def test_op10_query_equals_sums(spark, tables):
    own = bpe.coder(RANKS, PATTERN)
    toxic = {x.doc_id for x in tables["labels"] if x.toxic == 1}
    want = defaultdict(lambda: [0, 0, 0])
    for d in tables["documents"]:
        if d.doc_id not in toxic:
            words = sum(any(c.isalnum() for c in w) for w in (d.text or "").replace("\x85", "x").encode().decode().split())
            for version, n in (("words-1", words), ("byte_bpe_multi_50k", own.count(d.text or ""))):
                for k, v in enumerate((1, n, len(d.text or ""))):
                    want[d.source, d.lang, version][k] += v
    found = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.QUERIES["op10_token_counts"](spark, SF).collect()}
    assert found == dict(want)


@needs_data
def test_pipeline_leaves_no_blank_text_and_finds_near_copies(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    before = None
    for name, stage in p.STAGES[:3]:
        if name == "line_dedup":
            before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = p.staged(stage(spark, docs, SF.replace("sf0.001", "sf0.01")), name)
    after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    texts = dict(before)
    assert not [d for d, t in after.items() if not (t or "").strip() and (texts[d] or "").strip()]
    want = brute_components(before, 5, 80, 100)
    copies = {d for d, (_, root) in want.items() if root < d}
    assert copies and sum(d not in after for d in copies) >= 0.9 * len(copies)
    alone = [d for d, (_, root) in want.items() if list(want.values()).count(want[d]) == 1 and (texts[d] or "").strip()]
    assert sum(d in after for d in alone) >= 0.97 * len(alone)
