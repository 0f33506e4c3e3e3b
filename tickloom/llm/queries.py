"""The queries over the corpus operators, with their production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, exact_dedup, lexical, line_dedup, lm, ngram_join, oracle, pii, quality, sharding, token_counts, toxicity, trie
from tickloom.llm.common import shared_folder, staged

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of each language arrive one after another as small shards, runs of similar sizes are merged, and the newest version is read back.

    A row per document; beside it the rows that the manifest lists, the arrivals
    that committed, those that a retry committed again, and whether shards were
    merged.  Sixteen arrivals under half the target always are: there are five
    factors of four between the smallest and half the largest size, and three
    shards of each are not yet a run.
    """
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_folder(spark)}/tickloom/shards-{uuid.uuid4().hex}", docs.schema)
    quarter = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.pmod("doc_id", F.lit(4)).cast("string"))
    arrivals = store.append_by(docs, quarter)
    again = store.append_by(docs, quarter)  # a retry: every arrival is known
    replaced = store.vacuum(keep=1)  # nobody reads the versions in between
    said = store.manifest().agg(F.sum("rows"), F.count("*")).first()
    read = store.read().select("doc_id", quarter.alias("arrival"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    counts = {"manifest_rows": said[0] or 0, "arrivals": len(arrivals), "arrivals_again": len(again)}
    return read.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()} | {"merged": F.lit(replaced > 0)})


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of whole texts at 3-word shingles and a Jaccard similarity of 0.9, closed to components."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it counts as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "toxic")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal whole texts; the largest id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 10 code points that repeat across documents go, except in the smallest id."""
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 10)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within 15 % of edits: a row per document and item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, and the terms that give it away."""
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after inserts, revised counts and deletes, with a batch sent twice."""
    docs = table(spark, sf_dir, "documents")
    counts = staged(token_counts.document_counts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN), "counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/tickloom/rollup-{uuid.uuid4().hex}")
    rollup.apply("words", token_counts.signed(counts, 1, "words-1", "blanks"))
    rollup.apply("bpe", token_counts.signed(counts, 1, "byte_bpe_multi_50k", "bpe"))
    rollup.apply("recount", token_counts.revised(counts, "words-1", "blanks", "words"))
    rollup.apply("bpe", token_counts.signed(counts, 1, "byte_bpe_multi_50k", "bpe"))
    rollup.apply("toxic", token_counts.signed(gone, -1, "words-1", "words").union(token_counts.signed(gone, -1, "byte_bpe_multi_50k", "bpe")))
    return rollup.totals()


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under a trigram model of the training fold, and under exact counts of single words."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(lm.fold(F.col("doc_id")) == 1, F.lit(False))
    scores = lm.score(docs, lm.train(docs.where(~held_out)))
    return scores.select("doc_id", F.coalesce(lm.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": oracle.SHARDS,
    "op2_ngram_jaccard": oracle.ngram_components(3, 90, 100),
    "op5_exact_dedup": oracle.EXACT_GROUPS,
    "op6_line_dedup": oracle.LINES,
    "op12_ranked_search": oracle.RANKED,
    "op13_prefix_trie": oracle.TRIE,
}
