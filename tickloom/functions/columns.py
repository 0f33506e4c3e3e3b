"""Column helpers: windows over a ticker's bars, clipping, ranks, step functions, order of shown rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker():
    """A ticker's bars in order of date."""
    return Window.partitionBy("ticker").orderBy("d")


def last_bars(n: int):
    """The last ``n`` bars of a ticker, the current one included."""
    return by_ticker().rowsBetween(-(n - 1), 0)


def full(column: Column | str, n: int, agg) -> Column:
    """An aggregate over the last ``n`` bars, null until there are ``n``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.col("t") >= n - 1, agg(column).over(last_bars(n)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """``a / b`` where b is positive, else ``otherwise``."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(otherwise))


def passes(*rejections: Column) -> Column:
    """True where no rejection holds; a comparison with null rejects nothing."""
    out = F.lit(True)
    for r in rejections:
        out = out & ~F.coalesce(r, F.lit(False))
    return out


def steps(x: Column, at_least: list[tuple[float, float]], otherwise: float | Column) -> Column:
    """The value of the first bound that ``x`` reaches."""
    out = None
    for bound, value in at_least:
        out = F.when(x >= bound, F.lit(value)) if out is None else out.when(x >= bound, F.lit(value))
    return out.otherwise(otherwise)


def percentile_rank(x: Column, *pool: str) -> Column:
    """Average rank of ties over the pool's size, in percent; 100 in a pool of one."""
    w, ties = Window.partitionBy(*pool), Window.partitionBy(*pool, x)
    return (F.rank().over(w.orderBy(x)) + (F.count("*").over(ties) - 1) / 2e0) / F.count("*").over(w) * 100


def sigmoid(x: Column) -> Column:
    return 1e0 / (1e0 + F.exp(-x))


def phrase(*parts: Column) -> Column:
    """Fragments joined by commas with a full stop; null fragments are left out."""
    return F.concat(F.concat_ws(", ", *parts), F.lit("."))


def rounded(**columns: tuple[Column | str, int] | Column) -> list[Column]:
    """Columns rounded to so many places, under their names."""
    return [F.round(*c).alias(n) if isinstance(c, tuple) else c.alias(n) for n, c in columns.items()]


def percent_up(price: Column, percent: int) -> Column:
    """A price in cents raised by whole percents, rounded half up to cents by integer arithmetic."""
    cents = F.round(price * 100).cast("long") * (100 + percent)
    return F.floor((cents + 50) / 100) / 100e0


def in_order(rows: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Rows by any column, either way, missing values last; a sort over ranges, so no task gets them all."""
    by = F.col(column)
    return rows.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), tie)
