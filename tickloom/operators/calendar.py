"""Trading days and market hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
#: Exchange holidays (fixed values).
HOLIDAYS = (
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)


def next_trading_day(day: Column) -> Column:
    """The next weekday (weekends only, no holidays)."""
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def market_open(utc: Column) -> Column:
    """Weekday, no holiday, and 04:00 to 20:00 in New York."""
    local = F.from_utc_timestamp(utc, "America/New_York")
    return (F.weekday(local) < 5) & ~F.to_date(local).cast("string").isin(*HOLIDAYS) & F.hour(local).between(4, 19)


def weekdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Business days with their number."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).where(F.weekday("d") < 5)
    return days.withColumn("n", F.row_number().over(Window.orderBy("d")))


def business_days_ago(day: Column, n: int) -> Column:
    """``n`` weekdays before a date, by arithmetic on whole weeks (a weekend day counts as the Friday before)."""
    moved = F.weekday(day)
    friday = F.date_sub(day, F.when(moved > 4, moved - 4).otherwise(0))
    at = F.least(moved, F.lit(4))
    rest = n % 5
    extra = F.when(at < rest, 2).otherwise(0)
    return F.date_sub(friday, F.lit(n // 5 * 7 + rest) + extra)
