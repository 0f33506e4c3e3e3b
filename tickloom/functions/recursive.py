"""Recursive filters as window sums, without Python.

``R_t = b R_{t-1} + y_t`` is ``b**t`` times the running sum of ``y_i b**-i``.  To
keep the powers in range however long a series is, bars are cut into blocks of
``BLOCK``; a block starts from the value at the end of the one before it, whose
own past has decayed below a double's precision by then.  All filters of a call
share two window stages over the same partitioning by ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def decayed_sums(bars: DataFrame, filters: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add a column per filter: name to (``y``, ``b``).  ``bars`` has ``ticker`` and the bar number ``t``."""
    bars = bars.withColumns({"_block": F.floor(F.col("t") / BLOCK), "_k": F.pmod("t", F.lit(BLOCK)).cast("double")})
    inside = Window.partitionBy("ticker", "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("ticker").orderBy("_block").rangeBetween(-1, -1)
    power = lambda b, k: F.pow(F.lit(b), k)
    bars = bars.withColumns({f"_{n}": power(b, F.col("_k")) * F.sum(y * power(b, -F.col("_k"))).over(inside) for n, (y, b) in filters.items()})
    carried = {n: F.col(f"_{n}") + F.coalesce(power(b, F.col("_k") + 1) * F.max_by(f"_{n}", "t").over(before), F.lit(0.0)) for n, (_, b) in filters.items()}
    return bars.withColumns(carried).drop("_block", "_k", *(f"_{n}" for n in filters))


def ema(x: Column, span: int) -> tuple[Column, float]:
    """Exponential mean with weight 2/(span+1), started at the first value."""
    a = 2.0 / (span + 1)
    return F.when(F.col("t") == 0, x).otherwise(x * a), 1 - a


def wilder_sum(x: Column, n: int) -> tuple[Column, float]:
    """``S_t = S_{t-1} (1 - 1/n) + x_t`` from the sum of the first ``n`` bars on; 0 before (see ``wilder``)."""
    first = F.sum(x).over(Window.partitionBy("ticker").orderBy("t").rowsBetween(-(n - 1), 0))
    return F.when(F.col("t") < n - 1, 0.0).when(F.col("t") == n - 1, first).otherwise(x), 1 - 1.0 / n


def from_first(column: str, x: Column, n: int) -> Column:
    """A Wilder sum whose bars before ``n - 1`` all carry the sum of the first ``n``."""
    whole = F.sum(F.when(F.col("t") < n, x)).over(Window.partitionBy("ticker"))
    return F.when(F.col("t") < n - 1, whole).otherwise(F.col(column))
