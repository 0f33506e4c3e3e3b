"""Ranked lexical search by TPUT over term-partitioned postings.

All items are searched together, in three phases over postings that are
partitioned and sorted by term and weight (a list that many documents are on is
spread over partitions by its weights):

1. The documents at the heads of an item's lists are scored; the item's k-th best
   of these scores is a lower bound of its k-th best score.
2. All lists of an item are cut at one threshold: the largest at which a document
   under it in every list stays below the bound (a list adds its first posting at
   most, which the head tells).  All postings over it are fetched, whatever the
   lists' lengths.  They give partial scores, hence a better bound, and an upper
   bound for each document: a list in which it was not fetched adds the threshold
   or the list's first posting at most.
3. The exact scores of documents whose upper bound reaches the bound are looked up
   in the documents' own terms.

A term's place in a list does not depend on the item: the score of a posting is
the item's number of repeats times the term's weight times the document's part.
Scores are 64-bit integers, as the ranking rule asks for; weights are logarithms
in doubles, rounded down.

Only postings of terms that some item has are kept, by a Bloom filter of bounded
size over the items' terms (a false positive is a list that nobody asks for).

Defined cases: a null text has no terms; an item without terms, or with terms that
no document holds, has no rows; rows of one item id are one item, the same text
counted once; items without an id are left out; documents without an id count in
all statistics and are not ranked; a document that comes twice is ranked twice;
equal scores go by ascending id; scores of 0 are no hits; other columns are
ignored, whatever their names.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import as_batch, discard, light_batches, sent, small_batches, staged
from tickloom.llm.words import NO_TERM, Splitter

C = F.col
MOST_LISTS = 1 << 20  # lists of all items (some 40 bytes each) that are broadcast; beyond, they are joined by shuffles
SCALE, LENGTH = 1_000_000_000, 75  # fixed values of the ranking rule: scale of a part, percent of length in its denominator

_ITEM = pa.schema([("item_id", pa.int64()), ("term", pa.int64()), ("q", pa.int64())])
_DOC = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64()))])


def _counted(splitter: Splitter, batch: pa.RecordBatch, held: np.ndarray | None):
    """Per text of a batch: its number of terms, and its different terms (those that the filter may hold) with their counts."""
    words, sizes = splitter.words(batch.column("text"))
    text = np.repeat(np.arange(len(sizes)), sizes)
    if held is not None:
        own, back = np.unique(words, return_inverse=True)
        keep = bloom.contains(held, own)[back] if len(own) else np.zeros(0, bool)
        words, text = words[keep], text[keep]
    order = np.lexsort((words, text))
    words, text = words[order], text[order]
    at = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (text[1:] != text[:-1]))) if len(words) else np.empty(0, np.int64)
    return sizes, text[at], words[at].view(np.int64), np.diff(np.append(at, len(words)))


def _item_terms(batches):
    splitter = Splitter(NO_TERM)
    for batch in small_batches(batches, "text"):
        _, text, terms, counts = _counted(splitter, batch, None)
        yield as_batch(_ITEM, batch.column("item_id").take(pa.array(text)), terms, counts)


def _doc_terms(batches, sent_filter):
    splitter, row = Splitter(NO_TERM), TaskContext.get().partitionId() << 33
    for batch in small_batches(batches, "text"):
        sizes, text, terms, counts = _counted(splitter, batch, sent_filter.value)
        cuts = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int64))) for x in (terms, counts)]
        yield as_batch(_DOC, np.arange(row, row + len(sizes)), batch.column("doc_id"), sizes, *lists)
        row += len(sizes)


def _kth(scores: DataFrame, by: str, k: int) -> DataFrame:
    """``item_id, bound``: the k-th best score of each item, 0 where it has fewer."""
    first = Window.partitionBy("item_id").orderBy(F.desc(by))
    top = scores.select("item_id", by).withColumn("_rank", F.row_number().over(first)).where(C("_rank") <= k)
    return top.groupBy("item_id").agg(F.when(F.count("*") == k, F.min(by)).otherwise(F.lit(0)).cast("long").alias("bound"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark = docs.sparkSession
    items = items.select(C(item_id).cast("long").alias("item_id"), C(item_text).alias("text")).where("item_id is not null").distinct()
    asked = items.transform(light_batches).mapInArrow(_item_terms, "item_id long, term long, q long")
    asked = staged(asked.groupBy("item_id", "term").agg(F.sum("q").alias("q")), "asked")
    terms = asked.select("term").distinct()
    docs = docs.select(C(id_col).cast("long").alias("doc_id"), C(text_col).alias("text"))
    with sent(spark, bloom.of_longs(terms, terms.count())) as held:
        # row numbers are given once, as the rows are written
        rows = staged(docs.transform(light_batches).mapInArrow(lambda b: _doc_terms(b, held), "row long, doc_id long, n long, terms array<long>, tfs array<long>"), "doc_terms")
    said = rows.agg(F.count(F.when(C("n") > 0, True)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    # postings: the part of a score that the document alone decides, by term and from the best down
    m = F.expr(f"{100 - LENGTH} + ({LENGTH} * n * {said.docs}L) div {max(1, said.terms)}L")
    each = rows.select("row", "doc_id", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    each = each.select(C("x.terms").alias("term"), F.expr(f"({SCALE}L * x.tfs) div (1000L * x.tfs + 8L * m)").alias("part"), "row", "doc_id")
    postings = each.repartitionByRange("term", F.desc("part"), "row").sortWithinPartitions("term", F.desc("part"), "row")
    postings = staged(postings, "postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(said.docs) + 2) / (2 * C("df") + 1))).cast("long")
    # a term's lists: what one occurrence in the item is worth, and over how many lists its item spreads
    lists = asked.join(df, "term").withColumn("worth", C("q") * weight).where("worth > 0")
    lists = staged(lists.withColumn("lists", F.count("*").over(Window.partitionBy("item_id"))).select("item_id", "term", "worth", "lists"), "lists")
    ranked = postings.where("doc_id is not null")

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores of pairs of item and row, from all terms of the row."""
        each = pairs.join(rows.select("row", "doc_id", m.alias("m"), "terms", "tfs"), "row").select("item_id", "row", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        each = each.select("item_id", "row", "doc_id", C("x.terms").alias("term"), F.expr(f"({SCALE}L * x.tfs) div (1000L * x.tfs + 8L * m)").alias("part"))
        return each.join(lists, ["item_id", "term"]).groupBy("item_id", "row", "doc_id").agg(F.sum(C("worth") * C("part")).alias("score"))

    best = Window.partitionBy("term").orderBy(F.desc("part"), "row")
    heads = staged(ranked.withColumn("_rank", F.row_number().over(best)).where(C("_rank") <= k).select("term", "part", "row"), "heads")
    bounds = _kth(exact(heads.join(lists, "term").select("item_id", "row").distinct()), "score", k)

    # the threshold: lists that cannot reach it (the first of them, by their first posting) leave it to the others
    tops = lists.join(heads.groupBy("term").agg(F.max("part").alias("first")), "term").join(bounds, "item_id").withColumn("top", C("worth") * C("first"))
    low = Window.partitionBy("item_id").orderBy("top", "term")
    before = F.coalesce(F.sum("top").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.withColumns({"_sum": before, "_left": C("lists") - F.row_number().over(low) + 1})
    tops = tops.withColumn("_share", F.when(C("bound") > 0, F.expr("(bound - 1 - _sum) div _left")).otherwise(F.lit(-1)))
    share = F.coalesce(F.min(F.when(C("top") >= C("_share"), F.struct(-C("_left"), "_share"))).over(Window.partitionBy("item_id"))["_share"], F.lit(-1))
    tops = tops.withColumn("share", share).withColumn("most", F.greatest(F.lit(0), F.least("share", "top")))
    cuts = tops.select("item_id", "term", "worth", "bound", "most", F.when(C("share") < 0, F.lit(0)).otherwise(F.expr("share div worth + 1")).alias("cut"), F.sum("most").over(Window.partitionBy("item_id")).alias("unseen"))
    cuts = staged(cuts, "cuts")
    sides = F.broadcast(cuts) if lists.count() <= MOST_LISTS else cuts

    over = ranked.join(cuts.groupBy("term").agg(F.min("cut").alias("least")), "term").where("part >= least").select("term", "part", "row")
    # a document's postings meet first, and then the items: pairs of the two are summed where they arise
    fetched = over.repartition("row").join(sides, "term").where("part >= cut").withColumn("seen", C("worth") * C("part"))
    fetched = fetched.groupBy("row", "item_id").agg(F.sum("seen").alias("seen"), (F.first("unseen") + F.sum(C("seen") - C("most"))).alias("upper"), F.first("bound").alias("bound"))
    fetched = staged(fetched.where("upper >= bound"), "fetched")
    wanted = fetched.join(_kth(fetched, "seen", k).withColumnRenamed("bound", "better"), "item_id").where("upper >= better").select("item_id", "row")
    wanted = staged(wanted, "wanted")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")
    out = staged(exact(wanted).where("score > 0").withColumn("rank", F.row_number().over(order)).where(C("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    for table in (asked, rows, postings, lists, heads, cuts, fetched, wanted):
        discard(table)
    return out
