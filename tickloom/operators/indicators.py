"""Technical indicators as window columns over bars: one shuffle on the ticker for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import by_ticker, clip, full, last_bars, ratio
from tickloom.functions.recursive import decayed_sums, ema, from_first, wilder_sum

C = F.col


def moves(bars: DataFrame) -> DataFrame:
    """Bar-to-bar moves: return, gain, loss, true range, directional moves."""
    prev = {n: F.lag(n).over(by_ticker()) for n in ("close", "high", "low")}
    bars = bars.withColumns({f"_{n}": c for n, c in prev.items()})
    change = C("close") - C("_close")
    # rounded to 8 places so that equal moves compare as equal
    up, down = F.coalesce(F.round(C("high") - C("_high"), 8), F.lit(0.0)), F.coalesce(F.round(C("_low") - C("low"), 8), F.lit(0.0))
    bars = bars.withColumns({
        "ret": F.when(C("_close") > 0, C("close") / C("_close") - 1),
        "gain": F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0)),
        "loss": F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0)),
        "tr": F.greatest(C("high") - C("low"), F.abs(C("high") - C("_close")), F.abs(C("low") - C("_close"))),
        "_up": up, "_down": down,
    })
    bars = bars.withColumn("dm_plus", F.when((C("_up") > C("_down")) & (C("_up") > 0), C("_up")).otherwise(0.0))
    bars = bars.withColumn("dm_minus", F.when((C("_down") > C("dm_plus")) & (C("_down") > 0), C("_down")).otherwise(0.0))
    return bars.drop("_close", "_high", "_low", "_up", "_down")


def recursive_indicators(moved: DataFrame) -> DataFrame:
    """RSI 14, ADX 14, MACD (12, 26, 9), EMA 20 and the two recursive ATRs, in two passes of shared windows."""
    # the SMA-seeded ATR starts at bar 14 with the mean of true ranges 1 to 14
    seed = F.avg(F.when(C("t") >= 1, C("tr"))).over(last_bars(14))
    atr_in = F.when(C("t") < 14, 0.0).when(C("t") == 14, seed).otherwise(C("tr") / 14)
    first = decayed_sums(moved, {
        "avg_gain": ema(C("gain"), 14), "avg_loss": ema(C("loss"), 14), "atr_14": ema(C("tr"), 14), "ema_20": ema(C("close"), 20),
        "ema_12": ema(C("close"), 12), "ema_26": ema(C("close"), 26),
        "s_tr": wilder_sum(C("tr"), 14), "s_plus": wilder_sum(C("dm_plus"), 14), "s_minus": wilder_sum(C("dm_minus"), 14),
        "_atr_w": (atr_in, 13 / 14),
    })
    first = first.withColumns({s: from_first(s, C(x), 14) for s, x in (("s_tr", "tr"), ("s_plus", "dm_plus"), ("s_minus", "dm_minus"))})
    first = first.withColumns({
        "rsi_14": F.when(C("avg_loss") != 0, 100 - 100 / (1 + C("avg_gain") / C("avg_loss"))),
        "macd": C("ema_12") - C("ema_26"),
        "di_plus": 100 * F.try_divide(C("s_plus"), C("s_tr")), "di_minus": 100 * F.try_divide(C("s_minus"), C("s_tr")),
        "atr_wilder": F.when(C("t") >= 14, C("_atr_w")),
    })
    first = first.withColumn("dx", F.coalesce(100 * F.try_divide(F.abs(C("di_plus") - C("di_minus")), C("di_plus") + C("di_minus")), F.lit(0.0)))
    second = decayed_sums(first, {"macd_signal": ema(C("macd"), 9), "s_dx": wilder_sum(C("dx"), 14)})
    second = second.withColumns({"adx_14": from_first("s_dx", C("dx"), 14) / 14, "macd_hist": C("macd") - C("macd_signal")})
    return second.drop("avg_gain", "avg_loss", "ema_12", "ema_26", "s_tr", "s_plus", "s_minus", "s_dx", "dx", "_atr_w")


def swing_low() -> F.Column:
    """The latest low among bars t-17 to t-2 that is below its two neighbours on each side and below the close."""
    reach = [F.when(F.lag("pivot", k).over(by_ticker()) & (F.lag("low", k).over(by_ticker()) < C("close")), F.lag("low", k).over(by_ticker())) for k in range(2, 18)]
    return F.when(C("t") >= 19, F.coalesce(*reach))


def window_indicators(bars: DataFrame) -> DataFrame:
    """Everything that a fixed number of bars decides."""
    near = [F.lag("low", k).over(by_ticker()) for k in (1, 2)] + [F.lead("low", k).over(by_ticker()) for k in (1, 2)]
    pivot = reduce(lambda a, b: a & b, [C("low") < x for x in near])
    mid, dev = full("close", 20, F.avg), full("close", 20, F.stddev_samp)
    volume_full = full("volume", 20, F.avg)
    spread = F.avg(C("high") - C("low")).over(last_bars(14))
    out = bars.withColumns({
        "n_bars": C("t") + 1,
        "dma_50": F.avg("close").over(last_bars(50)), "dma_200": F.avg("close").over(last_bars(200)),
        "sma_20": mid, "sma_50": full("close", 50, F.avg), "sma_200": full("close", 200, F.avg),
        "volume_ma_20": F.avg("volume").over(last_bars(20)), "volume_ratio": ratio(C("volume"), volume_full, 0.0),
        "bb_up": mid + 2 * dev, "bb_low": mid - 2 * dev,
        "high_20": full("high", 20, F.max), "high_252": full("high", 252, F.max), "low_10": full("low", 10, F.min), "low_20": full("low", 20, F.min),
        "rsi_min_10": full("rsi_14", 10, F.min), "rsi_min_5": full("rsi_14", 5, F.min),
        "return_63": (ratio(C("close"), F.lag("close", 62).over(by_ticker())) - 1) * 100,
        "worst_5": F.min("ret").over(last_bars(5)), "best_5": F.max("ret").over(last_bars(5)),
        "atr_proxy": F.when((C("t") >= 13) & (spread > 0), spread).otherwise(C("close") * 0.02),
        "pivot": F.coalesce(pivot, F.lit(False)),
    })
    return out.withColumns({
        "bb_position": F.when(C("bb_up") == C("bb_low"), 0.5).otherwise((C("close") - C("bb_low")) / (C("bb_up") - C("bb_low"))),
        "swing_low": swing_low(),
        "from_high_20": F.when(C("high_20") > 0, (C("high_20") - C("close")) / C("high_20") * 100),
    })


def all_indicators(bars: DataFrame) -> DataFrame:
    return window_indicators(recursive_indicators(moves(bars)))


def recovery(dip: float = 45, low: float = 45, high: float = 62) -> F.Column:
    """RSI dipped below ``dip`` in the last 10 bars and is back between the bounds."""
    return F.coalesce((C("rsi_min_10") < dip) & C("rsi_14").between(low, high), F.lit(False))


def consensus_parts() -> dict[str, F.Column]:
    """Four scores whose mean must be over 0.65, with three of them over 0.5."""
    rsi, adx = F.coalesce(C("rsi_14"), F.lit(55.0)), F.coalesce(C("adx_14"), F.lit(20.0))
    volume = F.coalesce(C("volume_ratio"), F.lit(1.0))
    return {
        "rsi_part": 1 - F.abs(rsi - 55) / 35,
        "adx_part": F.least(F.lit(1.0), (adx - 10) / 25),
        "volume_part": F.least(F.lit(1.0), (volume - 0.5) / 1.5),
        "dma_part": F.when(C("dma_50") > 0, F.least(F.lit(1.0), (C("close") / C("dma_50") - 0.95) / 0.15)).otherwise(1.0),
    }


def consensus() -> F.Column:
    parts = list(consensus_parts().values())
    mean = reduce(lambda a, b: a + b, parts) / 4
    strong = reduce(lambda a, b: a + b, [(p > 0.5).cast("int") for p in parts])
    return (mean > 0.65) & (strong >= 3)


def price_volume_event() -> F.Column:
    """1.5, 1.0 or 0 by volume ratio and the bar's change, once there are 20 bars."""
    change = C("ret") * 100
    return F.when(C("t") < 19, 0.0).when((C("volume_ratio") > 2) & (change > 5), 1.5).when((C("volume_ratio") > 1.5) & (change > 2), 1.0).otherwise(0.0)


def latest(indicators: DataFrame, *partition: str) -> DataFrame:
    """The last bar of every ticker."""
    w = Window.partitionBy(*(partition or ("ticker",))).orderBy(F.desc("d"))
    return indicators.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hmm_features(index: DataFrame, vix: DataFrame) -> DataFrame:
    """20-bar log return, annualised deviation, vix/100 and share of rising bars of each series, on dates that both tables have."""
    both = index.join(vix.where("vix is not null"), "d").withColumn("t", (F.row_number().over(by_ticker()) - 1).cast("long"))
    both = both.withColumn("lr", F.log(C("close") / F.lag("close").over(by_ticker())))
    return both.withColumns({
        "return_20": F.log(C("close") / F.lag("close", 20).over(by_ticker())),
        "vol_20": F.when(C("t") >= 20, F.stddev_samp("lr").over(last_bars(20)) * F.sqrt(F.lit(252e0))),
        "vix_norm": C("vix") / 100,
        "breadth_20": full(F.when(C("lr") > 0, 1.0).otherwise(0.0), 20, F.avg),
    }).where("return_20 is not null and vol_20 is not null").select("ticker", "d", "return_20", "vol_20", "vix_norm", "breadth_20")


def significant_highs(bars: DataFrame, apart: float = 0.02) -> DataFrame:
    """Five-bar pivot highs of the last 120 bars, rounded, and thinned to ``apart`` from the last one kept."""
    pivot = bars.withColumn("top", F.max("high").over(by_ticker().rowsBetween(-2, 2))).withColumn("age", F.max("t").over(Window.partitionBy("ticker")) - C("t"))
    highs = pivot.where((C("high") == C("top")) & (C("age") < 120)).groupBy("ticker").agg(F.array_sort(F.collect_set(F.round("high", 2))).alias("highs"))
    keep = F.aggregate("highs", F.array().cast("array<double>"), lambda kept, h: F.when((F.size(kept) == 0) | (h > F.try_element_at(kept, F.lit(-1)) * (1 + apart)), F.concat(kept, F.array(h))).otherwise(kept))
    return highs.select("ticker", keep.alias("highs"))


def candles(bars: DataFrame) -> DataFrame:
    """Bullish engulfing, hammer and inside bar, by conventional rules of our own.

    Engulfing: a rising body that covers the falling body before it.  Hammer: the
    lower wick at least twice the body and the upper wick at most half of it.
    Inside bar: the range within the range before.  Entries: the close, or 0.1 %
    over the hammer's or inside bar's high.
    """
    o, c, h, low = (F.lag(x).over(by_ticker()) for x in ("open", "close", "high", "low"))
    body = F.abs(C("close") - C("open"))
    named = bars.withColumns({
        "engulfing": (C("close") > C("open")) & (c < o) & (C("close") >= o) & (C("open") <= c),
        "hammer": (body > 0) & (F.least("open", "close") - C("low") >= 2 * body) & (C("high") - F.greatest("open", "close") <= 0.5 * body),
        "inside": (C("high") < h) & (C("low") > low),
    })
    pattern = F.when(C("engulfing"), "engulfing").when(C("hammer"), "hammer").when(C("inside"), "inside")
    entry = F.when(C("engulfing"), C("close")).otherwise(C("high") * 1.001)
    return named.withColumns({"pattern": pattern, "entry": F.round(entry + 1e-9, 2)}).where("pattern is not null").select("ticker", "d", "t", "pattern", "entry")
