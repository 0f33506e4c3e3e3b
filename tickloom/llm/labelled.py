"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled documents as ``doc_id, text, label`` (and the documents are read once).

    The sample is taken by a hash of the id, so it does not depend on how the
    tables are dealt; its ids (``most`` longs) are the only rows broadcast.
    Rows without an id or label, and all but one label of an id, are left out.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_label").cast("int").alias("label"))
