"""Queries over readers, keyed tables and exports that are really written and read back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tickloom.operators import context, final
from tickloom.plans import oracle
from tickloom.plans.indicator_queries import C, bt_metrics, query
from tickloom.plans.more_queries import store
from tickloom.plans.position_queries import CASH, VALUE, held
from tickloom.plans.signal_queries import bars_with_indicators, context_scores, scan_union, wide_metrics
from tickloom.sources import market, provider, shared, tables

CTE = oracle.CTE
FIELDS = ("open", "high", "low", "close", "volume")


def _path(spark, name: str) -> str:
    return f"{shared.shared_folder(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


@query("SELECT ticker, d, open, high, low, close, volume FROM bars WHERE d BETWEEN DATE '1995-03-01' AND DATE '1999-10-15'")
def bars_provided(spark, sf_dir):
    """Bars of all tickers as a provider over a store hands them to the tasks that ask for chunks."""
    bars = market.bars(spark, sf_dir)
    source = provider.StoredProvider(store(bars, "provider"))
    return provider.fetched(bars.select("ticker"), source, date(1995, 3, 1), date(1999, 10, 15), chunk=4, calls=4)


@query("SELECT DISTINCT ticker FROM bars WHERE ticker NOT IN (SELECT ticker FROM bars WHERE d BETWEEN DATE '1995-04-03' AND DATE '1995-04-09')")
def bars_not_provided(spark, sf_dir):
    """Tickers for which a provider has no bar in a week."""
    bars = market.bars(spark, sf_dir)
    source = provider.StoredProvider(store(bars, "provider"))
    return provider.missing(bars.select("ticker"), provider.fetched(bars.select("ticker"), source, date(1995, 4, 3), date(1995, 4, 9)))


@query("SELECT ticker, d, open, high, low, close, volume FROM bars WHERE t % 7 <> 0 AND t % 11 <> 0 AND t % 13 <> 0")
def bars_cleaned(spark, sf_dir):
    """Raw bars with names in any case, dates as text, and closes or volumes that are null or NaN."""
    t = C("t")
    raw = market.bars(spark, sf_dir).select(
        C("ticker").alias("Ticker"), C("d").cast("string").alias("DATE"), C("open").alias("Open"), C("high").alias("HIGH"), C("low").alias("Low"),
        F.when(t % 7 == 0, F.lit(None)).when(t % 11 == 0, float("nan")).otherwise(C("close")).alias("Close"), F.when(t % 13 != 0, C("volume")).alias("VOLUME"), t.alias("extra"))
    return tables.clean_bars(raw)


@query("SELECT ticker, d, open, high, low, close, volume FROM bars")
def bars_wide_to_long(spark, sf_dir):
    """A row per date with columns ``TICKER|FIELD`` (as one bulk download has them) back to bars."""
    wide = market.bars(spark, sf_dir).groupBy("d").pivot("ticker").agg(*(F.max(f).alias(f.upper()) for f in FIELDS))
    return tables.wide_to_long(wide.toDF("d", *("|".join(c.rsplit("_", 1)) for c in wide.columns[1:])))


@query("SELECT ticker, d, close FROM bars WHERE t % 2 = 0 AND close > 100")
def table_replaced(spark, sf_dir):
    """A table swapped for rows that are read from it."""
    path = _path(spark, "swapped")
    tables.replace_table(spark, market.bars(spark, sf_dir).where("t % 2 = 0").select("ticker", "d", "close"), path)
    tables.replace_table(spark, spark.read.parquet(path).where("close > 100"), path)
    return spark.read.parquet(path)


@query("""SELECT id, ticker, status FROM held WHERE status IN ('open', 'pending')
  UNION ALL SELECT id, ticker, status FROM held WHERE status = 'closed' AND ticker NOT IN (SELECT ticker FROM held WHERE status IN ('open', 'pending') AND ticker IS NOT NULL)""")
def table_preferred(spark, sf_dir):
    """Closed and active positions by ticker: the active ones hide the ticker's history."""
    rows = shared.written(held(spark, sf_dir).select("id", "ticker", "status"), "held")
    return tables.preferred(rows.where("status = 'closed'"), rows.where("status in ('open', 'pending')"), ["ticker"])


@query("""SELECT ticker, total_signals, CAST(NULL AS DOUBLE) AS win_rate, wins FROM wide
  UNION ALL SELECT ticker, total_signals, win_rate, CAST(NULL AS BIGINT) FROM metrics WHERE ticker NOT IN (SELECT ticker FROM wide)""")
def table_ragged(spark, sf_dir):
    """An upsert whose rows lack a column of the table and have one that it lacks."""
    new = wide_metrics(bars_with_indicators(spark, sf_dir)).select("ticker", "total_signals", "wins")
    return tables.upserted(bt_metrics(spark, sf_dir).select("ticker", "total_signals", "win_rate"), new, ["ticker"])


@query("SELECT ticker, d, close, volume FROM bars")
def json_round_trip(spark, sf_dir):
    """Bars out to JSON files and back in a stated schema."""
    path = _path(spark, "json")
    tables.export_json(market.bars(spark, sf_dir).select("ticker", "d", "close", "volume"), path)
    return spark.read.schema("ticker string, d date, close double, volume double").json(path)


_A = "CAST(CASE WHEN target_mean_price IS NOT NULL AND target_mean_price <> 0 AND price > 0 AND recommendation IN ('buy', 'strong_buy') THEN 15 ELSE 0 END AS DOUBLE)"
_FILE = "# context weights\nanalyst:\n  buy_bonus: 25  # points\nnews:\n  sentiment_positive_threshold: 0.05\n  sentiment_negative_threshold: -0.4\nfundamental:\n  current_ratio_min: 1.2\n"
CTE["ctx_file"] = f"""SELECT ticker, a + {_A} AS a, e, CASE WHEN debt_to_equity < 1 THEN 10e0 ELSE 0e0 END + CASE WHEN current_ratio > 1.2e0 THEN 10e0 ELSE 0e0 END AS f,
  CASE WHEN sentiment > 0.05e0 THEN least(20e0, sentiment * 50) WHEN sentiment < -0.4e0 THEN -10e0 ELSE 0e0 END AS s, v, rsi_14, adx_14, volume_ratio FROM ctx1"""


@query("""SELECT ticker, round(greatest(0e0, least(100e0, CASE WHEN a + e + f + s + v = 0 THEN least(15e0, greatest(0e0, (rsi_14 - 30) / 70) * 5 + greatest(0e0, (adx_14 - 10) / 40) * 5 + greatest(0e0, (volume_ratio - 0.5e0) * 10)) ELSE a + e + f + s + v END)), 6) AS context_score FROM ctx_file""")
def ctx_weights_file(spark, sf_dir):
    """Context scores under weights from a file, with the defaults for what it lacks."""
    path = _path(spark, "weights")
    spark.createDataFrame([(_FILE,)], "value string").coalesce(1).write.text(path)
    return context_scores(spark, sf_dir, context.load_weights(spark, path)).select("ticker", F.round("context_score", 6).alias("context_score"))


_BY_ATR = ", ".join(f"CASE WHEN low_target <= entry_price THEN round(entry_price + {m}e0 * atr, 2) ELSE target_{k} END AS target_{k}" for k, m in ((1, 1.5), (2, 2.5), (3, 3.5)))


@query(f"SELECT b.d, b.ticker, stop_loss, {_BY_ATR} FROM (SELECT c.* REPLACE (CASE WHEN i.t % 2 = 0 THEN entry_price ELSE target_1 END AS target_1), CASE WHEN i.t % 2 = 0 THEN entry_price ELSE target_1 END AS low_target, i.atr_proxy AS atr FROM best3 c JOIN ind i ON c.ticker = i.ticker AND c.d = i.d) b")
def final_atr_targets(spark, sf_dir):
    """The nightly rows with their bar's ATR: first targets that are not over the entry (here every other bar's) are set anew, by ATR."""
    found = bars_with_indicators(spark, sf_dir)
    signals = shared.written(scan_union(spark, sf_dir), "signals")
    rows = signals.join(found.select("ticker", "d", C("t").alias("_t"), C("atr_proxy").alias("atr")), ["ticker", "d"])
    rows = rows.withColumn("target_1", F.when(C("_t") % 2 == 0, C("entry_price")).otherwise(C("target_1")))
    open_then = held(spark, sf_dir).where("status = 'open'").select("ticker", F.date_add("d", 7).alias("d"))
    return final.recommended(rows, VALUE, CASH, positions=open_then).select("d", "ticker", "stop_loss", "target_1", "target_2", "target_3")
