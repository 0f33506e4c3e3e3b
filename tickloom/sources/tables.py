"""Bar stores, universes and keyed tables: reads, incremental refresh, upserts and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
BAR = "ticker string, d date, open double, high double, low double, close double, volume double"


def clean_symbol(symbol: Column, dot: str = ".") -> Column:
    return F.upper(F.replace(F.trim(symbol), F.lit(dot), F.lit("-")))


def merged_universe(first: DataFrame, second: DataFrame, blacklist: list[str] = (), dot: str = ".") -> DataFrame:
    """Both lists with clean symbols; a symbol of the first list hides the second's, and the blacklist hides both."""
    a, b = (x.withColumn("ticker", clean_symbol(C("ticker"), dot)).dropDuplicates(["ticker"]) for x in (first, second))
    both = a.unionByName(b.join(a.select("ticker"), "ticker", "left_anti"))
    return both.where(~C("ticker").isin(list(blacklist))) if blacklist else both


def clean_bars(raw: DataFrame) -> DataFrame:
    """Columns in any letter case to the bar schema; rows without a close or volume go, NaN becomes null."""
    names = {c.lower(): c for c in raw.columns}
    missing = {"ticker", "close", "volume"} - set(names)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    day = C(names.get("d") or names["date"]).cast("date").alias("d")
    value = lambda c: F.when(~F.isnan(C(names[c]).cast("double")), C(names[c]).cast("double")) if c in names else F.lit(None).cast("double")
    return raw.select(C(names["ticker"]).alias("ticker"), day, *(value(c).alias(c) for c in ("open", "high", "low", "close", "volume"))).where("close is not null and volume is not null")


def wide_to_long(wide: DataFrame, day: str = "d") -> DataFrame:
    """Columns named ``TICKER|FIELD`` to one row per ticker and date; tickers without any value on a date go."""
    cells = wide.unpivot([day], [c for c in wide.columns if c != day], "_cell", "_value").where("_value is not null")
    parts = F.split("_cell", r"\|")
    named = cells.select(C(day).cast("date").alias("d"), parts[0].alias("ticker"), F.lower(parts[1]).alias("_field"), "_value")
    fields = ["open", "high", "low", "close", "volume"]
    return named.groupBy("ticker", "d").agg(*(F.max(F.when(C("_field") == f, C("_value"))).alias(f) for f in fields))


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def write_bars(bars: DataFrame, path: str, whole: bool = False) -> None:
    """Bars by month (not by day: a file per day is too small to scan); only months that occur are replaced, or the whole store."""
    bars.select("ticker", "d", "open", "high", "low", "close", "volume", month(C("d")).alias("month")).write.option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("month").mode("overwrite").parquet(path)


def read_bars(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, end_exclusive: bool = False) -> DataFrame:
    """Bars of a range of dates; the range prunes months as well as row groups."""
    bars = spark.read.schema(BAR + ", month string").parquet(path)
    if first:
        bars = bars.where((C("month") >= first[:7]) & (C("d") >= F.lit(first).cast("date")))
    if last:
        bars = bars.where((C("month") <= last[:7]) & ((C("d") < F.lit(last).cast("date")) if end_exclusive else (C("d") <= F.lit(last).cast("date"))))
    return bars.drop("month")


def refresh(spark: SparkSession, path: str, incoming: DataFrame) -> int:
    """Add the incoming bars that are later than the store's last date, rewriting the months they fall into; how many."""
    known = read_bars(spark, path)
    last = known.agg(F.max("d")).first()[0]
    new = incoming.where(C("d") > F.lit(last)) if last else incoming
    new = new.persist()
    count = new.count()
    if count:
        months = new.select(month(C("d")).alias("month")).distinct()
        same = known.withColumn("month", month(C("d"))).join(F.broadcast(months), "month", "left_semi").drop("month")
        # written aside first: a plan must not overwrite what it reads
        aside = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
        same.unionByName(new.select(*same.columns)).write.parquet(aside)
        write_bars(spark.read.schema(BAR).parquet(aside), path)
        _delete(spark, aside)
    new.unpersist()
    return count


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stale(last_date: Column, today: Column, most: int = 1) -> Column:
    """Whether the last bar is older than ``most - 1`` business days before today's business day."""
    from tickloom.operators.calendar import business_days_ago

    return last_date < business_days_ago(today, most - 1)


def upserted(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the changes' rows in place of those with the same key; columns that one side lacks are null."""
    kept = target.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def updated(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Join-update: values of the changes where they are given, else the old ones."""
    values = [c for c in changes.columns if c not in keys and c in target.columns]
    new = changes.select(*keys, *(C(c).alias(f"_new_{c}") for c in values))
    return target.join(new, keys, "left").withColumns({c: F.coalesce(C(f"_new_{c}"), C(c)) for c in values}).select(*target.columns)


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the second's."""
    return upserted(first, second, keys)


def replace_table(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Swap a table's files for new rows that may have been read from it.

    The new files are written aside; the old ones are renamed, and deleted only
    when the new ones stand in their place.  If that fails, they are put back.
    """
    path = path.rstrip("/")
    aside, before = f"{path}__{uuid.uuid4().hex}", f"{path}__before"
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where(before)):
        if fs.exists(where(path)):
            fs.delete(where(before), True)  # an earlier swap got as far as the new files
        else:
            fs.rename(where(before), where(path))  # it did not
    rows.write.parquet(aside)
    if fs.exists(where(path)) and not fs.rename(where(path), where(before)):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(where(aside), where(path)):
        fs.rename(where(before), where(path))
        raise OSError(f"could not move {aside} to {path}")
    fs.delete(where(before), True)


def inserted(target: DataFrame, new: DataFrame, kept: Column) -> DataFrame:
    """``target``'s rows for which ``kept`` holds, and the new rows; columns that one side lacks are null."""
    return target.where(F.coalesce(kept, F.lit(False))).unionByName(new, allowMissingColumns=True)


def current(rows: DataFrame, stamp: str, now: Column, hours: float) -> DataFrame:
    """Cached rows that were written within the last ``hours``; rows without a time are out of date."""
    age = F.unix_timestamp(now) - F.unix_timestamp(C(stamp).cast("timestamp"))
    return rows.where(age.between(0, int(hours * 3600)))


def covers(stored: DataFrame, first: str, last: str) -> DataFrame:
    """For each ticker of a store, whether its bars reach over a range of dates."""
    return stored.groupBy("ticker").agg(((F.min("d") <= F.lit(first).cast("date")) & (F.max("d") >= F.lit(last).cast("date"))).alias("covered"))


def quote(*sources: str) -> Column:
    """The first positive price of several quote sources, in order of preference."""
    return F.coalesce(*(F.when(C(s) > 0, C(s)) for s in sources))


MODES = ("force", "incremental", "local")


def refresh_mode(*choices: str | None, ci: bool = False) -> str:
    """The first of the choices (flag, argument, environment) that names a mode; else incremental on a build server, local elsewhere."""
    named = (c.strip().lower() for c in choices if c)
    return next((c for c in named if c in MODES), "incremental" if ci else "local")


def brought_up(spark: SparkSession, path: str, incoming: DataFrame, mode: str, today: str) -> int | None:
    """Bring a store up to date in one of ``MODES``; how many bars came, or None where nothing was asked for.

    "force" puts the incoming bars, which are not read from the store, in place of all
    that it holds.  "incremental" adds the bars later than its last date.  "local" does
    so only where that date is more than two trading days old, or there is none.
    """
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}")
    if mode == "force":
        write_bars(incoming, path, whole=True)
        return read_bars(spark, path).count()
    if mode == "local":
        last = read_bars(spark, path).agg(F.max("d").alias("last"))
        if last.select(F.coalesce(stale(C("last"), F.lit(today).cast("date"), 2), F.lit(True))).first()[0] is False:
            return None
    return refresh(spark, path, incoming)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, in the given schema; unreadable values are null."""
    return spark.read.option("header", True).schema(schema).csv(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
