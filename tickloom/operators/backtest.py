"""Historical signals, trade simulation by a hierarchy of blocks of bars, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
COST = 0.10  # percent per trade
SEARCH = 5  # bars in which an entry may trigger
BLOCK = 64  # bars of a block, and blocks of an upper block, whose least low and greatest high are looked at first


def signals(indicators: DataFrame, volume: float = 1.0, use: tuple[str, ...] = ("trend", "dip", "band", "volume")) -> DataFrame:
    """Pullback-recovery signals at every bar from the 201st to the last but one.

    ``use`` names the filters that apply (for ablations): trend, dip (RSI fell
    below 45 within 10 bars), band (RSI now 45 to 65), volume.
    """
    gates = {
        "trend": (C("close") > C("dma_50")) & (C("dma_50") > C("dma_200")),
        "dip": C("rsi_min_10") < 45,
        "band": C("rsi_14").between(45, 65),
        "volume": C("volume") > volume * C("volume_ma_20"),
    }
    last = F.max("t").over(Window.partitionBy("ticker"))
    found = indicators.withColumn("_last", last).where((C("t") >= 200) & (C("t") <= C("_last") - 1) & C("swing_low").isNotNull())
    for name in use:
        found = found.where(gates[name])
    entry = F.round(C("high") * 1.001, 2)
    found = found.select("ticker", "d", "t", entry.alias("entry"), C("swing_low").alias("stop")).where("stop < entry")
    return found.withColumn("target", F.round(C("entry") + 3 * (C("entry") - C("stop")), 2))


def _summed(rows: DataFrame, place: str, *fields: str) -> DataFrame:
    """Rows in blocks of ``BLOCK`` consecutive places: ``block``, the rows in order as ``rows``, and the least low and greatest high."""
    kept = F.collect_list(F.struct(C(place).alias("at"), *fields, "low", "high"))
    grouped = rows.groupBy("ticker", F.floor(C(place) / BLOCK).alias("block"))
    return grouped.agg(F.sort_array(kept).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))


def _first_touch(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """``fills`` with their first bar from ``entry_t`` on whose low reaches the stop or whose high the target, as struct ``x``.

    Bars are summed up in blocks of 64, and blocks in upper blocks of 64.  A fill
    looks through its own block, then the blocks of its own upper block, then the
    ticker's upper blocks, and from the first that reaches a price back down: one
    row of at most 64 entries each (of the ticker's length over 4096 at the top).
    Rows without a fill have no ``x``.
    """
    blocks = _summed(bars, "t", "open")
    uppers = _summed(blocks, "block")
    tops = uppers.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(C("block").alias("at"), "low", "high"))).alias("_tops"))

    def first(rows, after):
        return F.get(F.filter(rows, lambda x: after(x["at"]) & ((x["low"] <= C("stop")) | (x["high"] >= C("target")))), F.lit(0))

    def look(found: DataFrame, table: DataFrame, block, name: str, after) -> DataFrame:
        """``name``: the first row of the given block that reaches a price."""
        side = table.select(C("ticker").alias("_ticker"), C("block").alias("_block"), C("rows").alias("_rows"))
        found = found.join(side, (C("ticker") == C("_ticker")) & (block == C("_block")), "left")
        return found.withColumn(name, first(C("_rows"), after)).drop("_ticker", "_block", "_rows")

    own, upper = F.floor(C("entry_t") / BLOCK), F.floor(C("entry_t") / (BLOCK * BLOCK))
    found = look(fills, blocks, own, "_bar", lambda at: at >= C("entry_t"))
    found = look(found, uppers, F.when(C("_bar").isNull(), upper), "_near", lambda at: at > own)
    found = found.join(tops, "ticker", "left").withColumn("_top", F.when(C("_bar").isNull() & C("_near").isNull(), first(C("_tops"), lambda at: at > upper))).drop("_tops")
    found = look(found, uppers, C("_top.at"), "_far", lambda at: F.lit(True))
    found = look(found, blocks, F.coalesce(C("_near.at"), C("_far.at")), "_later", lambda at: F.lit(True))
    x = F.coalesce("_bar", "_later")
    return found.withColumn("x", F.when(x.isNotNull(), F.struct(x["at"].alias("bt"), x["open"].alias("open"), x["low"].alias("low")))).drop("_bar", "_near", "_top", "_far", "_later")


def simulate(signals: DataFrame, bars: DataFrame, idealised: bool = False) -> DataFrame:
    """Each signal with its fill and exit; outcome null while unresolved.

    Entry: the first of the next bars whose high reaches the entry, filled at the
    entry or a higher open.  Exit, from the entry bar on: a later bar that opens
    at or under the stop, an open at or over the target, then low against stop,
    then high against target.  ``idealised`` fills at entry, stop and target and
    leaves costs out.  A signal's own bar carries the next ones, so an entry costs
    one row; an exit costs a few rows of blocks, however long the series is.
    """
    ahead = F.collect_list(F.struct(C("t").alias("bt"), "open", "high")).over(Window.partitionBy("ticker").orderBy("t").rowsBetween(1, SEARCH))
    rows = signals.select("ticker", "d", "t", "entry", "stop", "target").join(bars.select("ticker", "t", ahead.alias("_ahead")), ["ticker", "t"], "left")
    rows = rows.withColumn("f", F.get(F.filter("_ahead", lambda x: (x.high >= C("entry")) & (x.bt <= C("t") + SEARCH)), F.lit(0))).drop("_ahead")
    fill = C("entry") if idealised else F.greatest(C("entry"), C("f.open"))
    rows = _first_touch(rows.withColumns({"entry_t": C("f.bt"), "fill": F.when(C("f").isNotNull(), fill)}).drop("f"), bars)
    gap_down = (C("x.bt") > C("entry_t")) & (C("x.open") <= C("stop"))
    gap_up = C("x.open") >= C("target")
    loss = F.when(gap_down, True).when(gap_up, False).otherwise(C("x.low") <= C("stop"))
    price = F.when(loss, C("stop")).otherwise(C("target"))
    if not idealised:
        price = F.when(gap_down | gap_up, C("x.open")).otherwise(price)
    cost = 0.0 if idealised else COST
    done = C("x").isNotNull()
    rows = rows.withColumns({"outcome": F.when(done, F.when(loss, "loss").otherwise("win")), "holding": C("x.bt") - C("entry_t"), "exit": F.when(done, price)})
    rows = rows.withColumns({"entry_t": F.when(done, C("entry_t")), "fill": F.when(done, C("fill")), "return_pct": (C("exit") / C("fill") - 1) * 100 - cost})
    return rows.select("ticker", "d", "t", "entry", "stop", "target", "entry_t", "fill", "outcome", "holding", "exit", "return_pct")


def _count(condition) -> F.Column:
    return F.count(F.when(condition, True))


def trade_metrics() -> list[F.Column]:
    win = C("outcome") == "win"
    return [
        F.count("*").alias("total_signals"), _count(win).alias("wins"), _count(C("outcome") == "loss").alias("losses"),
        F.coalesce(F.round(F.avg("return_pct"), 4), F.lit(0.0)).alias("expectancy_pct"),
        F.coalesce(F.round(F.median("holding"), 1), F.lit(0.0)).alias("median_holding"),
        F.coalesce(F.round(F.median(F.when(win, C("return_pct"))), 4), F.lit(0.0)).alias("median_win_return"),
    ]


def metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts, win rate, expectancy and medians of trades by the given keys."""
    grouped = trades.groupBy(*keys) if keys else trades.groupBy()
    return grouped.agg(*trade_metrics()).withColumn("win_rate", F.coalesce(F.round(F.try_divide(C("wins") * 1e2, C("wins") + C("losses")), 2), F.lit(0.0)))


def ticker_metrics(trades: DataFrame, universe: DataFrame) -> DataFrame:
    """Metrics of every ticker of the universe, zeros where it had no signal."""
    found = metrics(trades, "ticker")
    zero = {n: F.coalesce(C(n), F.lit(0)) for n in ("total_signals", "wins", "losses")} | {n: F.coalesce(C(n), F.lit(0.0)) for n in ("expectancy_pct", "median_holding", "median_win_return", "win_rate")}
    return universe.select("ticker", "industry").join(found, "ticker", "left").withColumns(zero)


def wilson(wins: F.Column, n: F.Column, z: float = 1.96) -> tuple[F.Column, F.Column]:
    """The Wilson interval of a share, in percent."""
    p = F.try_divide(wins * 1e0, n)
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4e0 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n * 1e0)
    return (middle - half) / scale * 100, (middle + half) / scale * 100


def diagnostics(indicators: DataFrame) -> DataFrame:
    """How many bars fail each filter on its own, and their share of all bars."""
    fails = {
        "trend": ~((C("close") > C("dma_50")) & (C("dma_50") > C("dma_200"))),
        "dip": ~F.coalesce(C("rsi_min_10") < 45, F.lit(False)),
        "band": ~F.coalesce(C("rsi_14").between(45, 65), F.lit(False)),
        "volume": ~(C("volume") > C("volume_ma_20")),
        "swing_low": C("swing_low").isNull(),
    }
    counted = indicators.where("t >= 200").agg(F.count("*").alias("bars"), *(_count(c).alias(n) for n, c in fails.items()))
    long = counted.unpivot(["bars"], list(fails), "filter", "failures")
    return long.select("filter", "failures", F.round(F.try_divide(C("failures") * 1e2, C("bars")), 2).alias("failure_pct"))


def profitable_years(trades: DataFrame) -> DataFrame:
    """Years with decided trades, how many of them have a positive mean return, and the average holding."""
    years = trades.where("outcome is not null").groupBy(F.year("d").alias("y")).agg(F.avg("return_pct").alias("mean"), F.sum("holding").alias("h"), F.count("holding").alias("n"))
    return years.agg(F.count("*").alias("years"), _count(C("mean") > 0).alias("profitable_years"), F.round(F.try_divide(F.sum("h"), F.sum("n")) + 1e-8, 4).alias("average_holding"))
