"""Joins that Spark has no keyword for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: list[str], forward: bool = False) -> DataFrame:
    """Each left row with ``columns`` of the latest right row at or before its time (``forward``: the first after it).

    Both sides are stacked and the value is carried along one window: one
    shuffle on the key, no range join.  Rows without a match get nulls.
    """
    packed = right.select(on, F.col(right_time).alias("_time"), F.struct(*columns).alias("_right"))
    stacked = left.withColumns({"_time": F.col(left_time), "_side": F.lit(1)}).unionByName(packed.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("_time", "_side")
    # at equal times right rows sort first: they are seen looking back and not seen looking forward
    seen = F.first("_right", True).over(w.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("_right", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = stacked.withColumn("_seen", seen).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_seen.{c}").alias(c) for c in columns))


def differing(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """Keys that one side misses, or whose values differ by more than ``tolerance``."""
    a = left.select(*on, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("_a"))
    b = right.select(*on, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("_b"))
    both = a.join(b, on, "full_outer")
    apart = [F.when(F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > tolerance, ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))), F.lit(c)) for c in columns]
    kind = F.when(F.col("_a").isNull(), "missing left").when(F.col("_b").isNull(), "missing right").otherwise(F.concat_ws(",", *apart))
    return both.withColumn("difference", kind).where("difference <> ''").select(*on, "difference")
