"""Seven gated scans over bars with indicators, each as one filter and projection.

A scan runs as of every bar (``d`` is the scan date), so a nightly scan is the
same plan filtered to the last date.  A gate rejects on a true comparison; a null
operand rejects nothing, except where a scan says so.  Every scan gives the
columns of ``SIGNAL``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import by_ticker, clip, passes, percent_up, phrase, steps
from tickloom.operators import indicators as ind

C = F.col
SIGNAL = (
    "strategy", "ticker", "d", "price", "entry_price", "stop_loss", "target_1", "target_2", "target_3", "upside_pct", "weighted_rr", "current_rsi", "volume_ratio",
    "adx_value", "momentum_pts", "composite_score", "tier_label", "guard_reason", "quality_score", "narrative", "returns_3m", "days_since", "regime", "size_mult",
)
REGIMES = {
    "bull": ("pullback", "trend", "sector", "pead", "high_52w", "csm"),
    "sideways": ("pullback", "mean_reversion", "sector", "pead", "csm"),
    "bear": ("mean_reversion", "pead"),
}
ORDER = ("pullback", "trend", "mean_reversion", "sector", "pead", "high_52w", "csm")
CAPS = {"trend": 5, "mean_reversion": 5, "sector": 3, "pead": 3, "high_52w": 3, "csm": 5}
#: Target percentages, least bars, guard on trades, quality factor when blocked, and whether weak scores stay low.
RULES = {
    "pullback": ((7, 12, 18), 201, 5, 1.0), "trend": ((12, 22, 35), 200, 10, 0.3), "mean_reversion": ((5, 10, 15), 50, 10, 0.3),
    "sector": ((8, 15, 22), 60, 5, 0.8), "pead": ((8, 15, 22), 60, 5, 0.3), "high_52w": ((10, 18, 28), 252, 5, 0.8), "csm": ((10, 18, 25), 63, 5, 0.8),
}
#: Points for bull, sideways and other regimes.
REGIME_POINTS = {"trend": (10, 5, 0), "mean_reversion": (7, 10, 5), "sector": (10, 7, 5), "pead": (10, 8, 6), "high_52w": (10, 6, 3), "csm": (10, 6, 3)}
TIE = 1e-9  # prices on a tie round up in every engine
TIERS = [(70, "Strong Buy"), (50, "Buy"), (35, "Watch")]


def expectancy_points(strategy: str) -> Column:
    low = F.when(C("expectancy_pct") >= -5, 5).otherwise(0) if strategy in ("trend", "mean_reversion") else F.lit(5)
    return steps(C("expectancy_pct"), [(10, 40), (5, 35), (2, 25), (0, 15)], low)


def winrate_points(strategy: str) -> Column:
    bounds = [(70, 20), (60, 17), (50, 14)]
    if strategy in ("trend", "mean_reversion"):
        return steps(C("win_rate"), [*bounds, (40, 10), (25, 5)], 0)
    return steps(C("win_rate"), [*bounds, (40, 10)], 5) if strategy in ("sector", "pead") else steps(C("win_rate"), bounds, 5)


def regime_points(strategy: str) -> Column:
    bull, sideways, other = REGIME_POINTS[strategy]
    return F.when(C("regime") == "bull", bull).when(C("regime") == "sideways", sideways).otherwise(other)


def guard(strategy: str) -> Column:
    """The reason that blocks a signal; of several the last, except for the pullback scan, which joins its own."""
    if strategy == "pullback":
        reasons = F.concat_ws("; ", F.when(C("win_rate") < 35, "low win rate"), F.when(C("expectancy_pct") < 0, "negative expectancy"), F.when(C("total_signals") < 5, "few trades"))
        return F.when(reasons != "", reasons)
    trades = RULES[strategy][2]
    return F.when(C("total_signals") < trades, "few trades").when(C("expectancy_pct") < 1, "low expectancy").when(C("win_rate") < 50, "low win rate")


def weighted_rr() -> Column:
    gain = reduce(lambda a, b: a + b, [w * (C(f"target_{k}") - C("entry_price")) for k, w in ((1, 0.5), (2, 0.3), (3, 0.2))])
    return F.when(C("entry_price") > C("stop_loss"), gain / (C("entry_price") - C("stop_loss"))).otherwise(0.0)


def _finish(found: DataFrame, strategy: str, entry: Column, stop: Column, momentum: Column, narrative: Column, least_risk: float = 2.5, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Prices, targets, risk gate, points, tier, guard and quality of the bars that passed a scan's own gates."""
    targets, _, _, factor = RULES[strategy]
    found = found.withColumns({"entry_price": F.round(entry + TIE, 2), "stop_loss": F.round(stop + TIE, 2)})
    risk = (C("entry_price") - C("stop_loss")) / C("entry_price") * 100
    found = found.where(passes(risk < least_risk, *extra))
    found = found.withColumns({f"target_{k}": percent_up(C("entry_price"), p) for k, p in enumerate(targets, 1)})
    points = F.lit(0) if strategy == "pullback" else expectancy_points(strategy) + winrate_points(strategy) + regime_points(strategy)
    found = found.withColumn("momentum_pts", momentum.cast("double"))
    found = found.withColumns({"composite_score": F.round(C("momentum_pts") + points, 4), "guard_reason": guard(strategy)})
    quality = F.when(C("guard_reason").isNotNull(), C("composite_score") * factor).otherwise(C("composite_score"))
    # a pullback's quality is never set by its ranker, so another scan's signal for the ticker is preferred
    found = found.withColumns({
        "strategy": F.lit(strategy), "price": C("close"), "weighted_rr": F.round(weighted_rr(), 4), "current_rsi": F.round("rsi_14", 4),
        "adx_value": F.round("adx_14", 4), "narrative": narrative, "upside_pct": F.round((C("target_1") / C("entry_price") - 1) * 100, 4),
        "tier_label": F.when(C("guard_reason").isNotNull(), "Blocked").otherwise(steps(C("composite_score"), TIERS, F.lit("Speculative"))),
        "quality_score": F.round(F.lit(0.0) if strategy == "pullback" else quality, 4), "volume_ratio": F.round("volume_ratio", 4), "returns_3m": F.round("return_63", 4),
        "days_since": C("days_since") if "days_since" in found.columns else F.lit(None).cast("int"),
        "size_mult": C("size_mult") if "size_mult" in found.columns else F.lit(1.0),
    })
    return found.select(*SIGNAL)


def pullback_gates(regime: Column) -> list[tuple[str, Column]]:
    """The pullback scan's gates in order: name and rejection."""
    bull = regime == "bull"
    exception = (C("close") >= C("dma_50") * 1.2) & (C("volume_ratio") >= 1.5) & (C("adx_14") >= 20)
    entry = F.round(C("high") * 1.001, 2)
    risk = (entry - C("swing_low")) / entry * 100
    return [
        ("history", C("n_bars") < 201),
        ("invalid", C("dma_50").isNull() | C("dma_200").isNull() | C("rsi_14").isNull() | C("rsi_min_10").isNull() | C("adx_14").isNull() | C("volume_ratio").isNull()),
        ("trend", F.when(bull, C("close") <= C("dma_50")).otherwise((C("close") <= C("dma_50")) | (C("dma_50") <= C("dma_200")))),
        ("rsi", F.when(exception, C("rsi_14") > 75).otherwise((C("rsi_min_10") >= 55) | (C("rsi_14") < 35) | (C("rsi_14") > 70))),
        ("adx", C("adx_14") < F.when(bull, 15).otherwise(18)),
        ("volume", F.round("volume_ratio", 2) < 0.8),
        ("swing_low", C("swing_low").isNull() | (C("swing_low") >= entry)),
        ("maxrisk", risk > 15),
        ("minrisk", risk < 2.5),
        ("maxgap", C("worst_5") * 100 < -5),
        ("trades", C("total_signals") < 10),
        ("earnings", (C("days_to_earnings") > 0) & (C("days_to_earnings") <= 7)),
    ]


def first_failed(regime: Column) -> Column:
    """The first gate that rejects a bar; null where it passes all."""
    gates = pullback_gates(regime)
    out = F.when(F.coalesce(gates[0][1], F.lit(False)), gates[0][0])
    for name, reject in gates[1:]:
        out = out.when(F.coalesce(reject, F.lit(False)), name)
    return out


def pullback(bars: DataFrame) -> DataFrame:
    """Pullback to a swing low in an uptrend with the RSI back from a dip."""
    found = bars.withColumn("_failed", first_failed(C("regime"))).where("_failed is null")
    ema, rsi, vr = (C("close") / C("ema_20") - 1) * 100, C("rsi_14"), C("volume_ratio")
    trend = F.when(C("ema_20") > 0, F.when(ema > 5, "Strong uptrend").when(ema > 2, "Rising trend").when(ema > -1, "At support").otherwise("Pullback to support")).otherwise("Trend unclear")
    volume = F.when(vr > 1.3, "strong volume").when(vr > 1.05, "volume confirming").when(vr > 0.9, "normal volume").otherwise("light volume")
    mood = F.when(rsi < 30, "deeply oversold").when(rsi < 40, "oversold bounce").when(rsi < 48, "recovering").when(rsi < 55, "neutral RSI").when(rsi < 62, "momentum building").when(rsi < 70, "strong momentum").otherwise("overbought")
    return _finish(found, "pullback", F.round(C("high") * 1.001, 2), C("swing_low"), F.lit(0), phrase(trend, volume, mood), least_risk=0)


def trend(bars: DataFrame) -> DataFrame:
    """Well above the 200-bar mean, close to the 20-bar high, with the indicators in consensus."""
    found = bars.where(passes(C("n_bars") < 200, C("close") <= C("sma_200") * 1.02, C("from_high_20") > 5, ~ind.consensus()))
    over, rsi, adx, vr = (C("close") / C("sma_200") - 1) * 100, C("rsi_14"), C("adx_14"), C("volume_ratio")
    stop = F.when(C("atr_14") > 0, F.greatest(C("low_10"), C("close") - 2.5 * C("atr_14"))).otherwise(F.greatest(C("low_10"), C("sma_200") * 0.98))
    told = phrase(
        F.when(over > 10, "Strong uptrend").when(over > 5, "Rising trend").otherwise("Above 200 DMA"),
        F.when(vr > 1.5, "strong volume").when(vr > 1.2, "volume confirming"),
        F.when(rsi > 70, "strong momentum").when(rsi > 60, "momentum building"),
        F.when(adx > 25, "powerful trend").when(adx > 20, "trend intact"),
    )
    return _finish(found, "trend", C("close"), stop, F.when(over > 15, 30).when(over > 10, 25).when(over > 5, 20).when(over > 2, 15).otherwise(10), told)


def mean_reversion(bars: DataFrame) -> DataFrame:
    """Oversold near the 20-bar low and the lower band."""
    over = (C("close") / C("low_20") - 1) * 100
    found = bars.where(passes(C("n_bars") < 50, C("rsi_14") >= 40, C("rsi_min_5") > 35, over > 8, C("volume_ratio") < 0.8, C("adx_14") > 40, C("bb_position") > 0.35))
    rsi, vr, bb = C("rsi_14"), C("volume_ratio"), C("bb_position")
    told = phrase(
        F.when(over < 1, "At 20-day low").when(over < 3, "Near 20-day low").otherwise("Bouncing from support"),
        F.when(rsi < 25, "deeply oversold").when(rsi < 30, "oversold bounce").otherwise("recovering RSI"),
        F.when(vr > 1.5, "strong volume on bounce").when(vr > 1.2, "volume confirming bounce").otherwise("normal volume"),
        F.when(bb < 0.1, "at lower Bollinger Band").when(bb < 0.2, "near lower band"),
    )
    points = F.when(rsi < 20, 30).when(rsi < 25, 27).when(rsi < 30, 24).when(rsi < 35, 20).otherwise(15)
    return _finish(found, "mean_reversion", C("close"), C("low_20") * 0.98, points, told)


def sector(bars: DataFrame) -> DataFrame:
    """Sector funds in an uptrend; a fund without trades is given default metrics."""
    none = F.coalesce(C("total_signals"), F.lit(0)) == 0
    bars = bars.withColumns({"win_rate": F.when(none, 55.0).otherwise(C("win_rate")), "expectancy_pct": F.when(none, 2.0).otherwise(C("expectancy_pct")), "total_signals": F.when(none, 5).otherwise(C("total_signals"))})
    rsi, adx, vr = C("rsi_14"), C("adx_14"), C("volume_ratio")
    found = bars.where(passes(~C("is_etf"), C("n_bars") < 60, C("close") <= C("sma_50"), C("close") <= C("sma_200"), (rsi < 45) | (rsi > 80), adx < 12, vr < 0.8, C("from_high_20") > 5))
    over = (C("close") / C("sma_200") - 1) * 100
    told = F.concat(C("industry"), F.lit(": "), phrase(
        F.when(over > 10, "Leading sector").when(over > 5, "Strong sector").otherwise("Sector uptrend"), F.when(rsi > 65, "strong momentum").otherwise("momentum building"),
        F.when(vr > 1.3, "heavy volume").when(vr > 1.1, "volume confirming"), F.when(adx > 25, "powerful trend").otherwise("trend intact")))
    points = F.when(over > 15, 30).when(over > 10, 27).when(over > 5, 24).when(over > 0, 20).otherwise(15)
    return _finish(found, "sector", C("close"), C("sma_50") * 0.97, points, told)


def pead(bars: DataFrame) -> DataFrame:
    """Drift after earnings 1 to 5 days ago; ``days_since`` counts days and is used as a number of bars, as the rule has it."""
    def back(c: str, more: int = 0) -> Column:
        return reduce(lambda a, k: a.when(C("days_since") == k, F.lag(c, k - 1 + more).over(by_ticker())), range(2, 6), F.when(C("days_since") == 1, F.lag(c, more).over(by_ticker()) if more else C(c)))

    def over_gap(agg, c: str) -> Column:
        return reduce(lambda a, k: a.when(C("days_since") == k, agg(c).over(by_ticker().rowsBetween(-(k - 1), 0))), range(2, 6), F.when(C("days_since") == 1, C(c)))

    bars = bars.withColumns({"_close": back("close"), "_prev": back("close", 1), "_vol": back("volume"), "_high": over_gap(F.max, "high"), "_low": over_gap(F.min, "low"), "_vavg": F.when(C("t") >= 19, C("volume_ma_20"))})
    gap = F.when(C("_prev") > 0, (C("_close") / C("_prev") - 1) * 100).otherwise(0.0)
    hold = F.when(C("_high") > C("_low"), (C("close") - C("_low")) / (C("_high") - C("_low"))).otherwise(1.0)
    bars = bars.withColumns({"_gap": gap, "_hold": hold})
    found = bars.where(C("days_since").isNotNull() & passes(
        C("n_bars") < 60, ~F.coalesce(C("best_5") >= 0.02, F.lit(False)), C("_gap") < 2, C("_hold") < 0.3, (C("close") / C("_high") - 1) * 100 < -5,
        C("close") <= C("sma_50"), C("_vol") < C("_vavg") * 1.5, C("adx_14") < 10))
    ratio = F.when(C("_vavg") > 0, C("_vol") / C("_vavg")).otherwise(0.0)
    told = phrase(F.concat(F.lit("Earnings gap +"), F.format_string("%.1f", "_gap"), F.lit("% "), C("days_since").cast("string"), F.lit("d ago")),
                  F.when(C("_hold") > 0.8, "holding strong").when(C("_hold") > 0.6, "holding most gains").otherwise("pulling back to support"),
                  F.when(ratio > 3, "massive volume").when(ratio > 2, "strong volume"))
    points = F.when(C("_gap") >= 10, 30).when(C("_gap") >= 7, 27).when(C("_gap") >= 5, 24).otherwise(20) - F.when(C("_hold") >= 0.8, 0).when(C("_hold") >= 0.6, 2).otherwise(5)
    return _finish(found, "pead", C("close"), F.greatest(C("sma_50") * 0.98, C("_low") * 1.02), points, told)


def high_52w(bars: DataFrame) -> DataFrame:
    """Within reach of the 252-bar high."""
    below, rsi, adx, vr = (C("close") / C("high_252") - 1) * 100, C("rsi_14"), C("adx_14"), C("volume_ratio")
    found = bars.where(passes(C("n_bars") < 252, below < -5, C("close") <= C("sma_50"), (rsi < 45) | (rsi > 80), adx < 15, vr < 0.8, C("from_high_20") > 5))
    told = phrase(F.when(below > -0.5, "At 52-week high").otherwise("Near 52-week high"), F.when(vr > 2, "massive breakout volume").when(vr > 1.5, "strong breakout volume").otherwise("volume confirming"), F.when(adx > 25, "powerful trend").otherwise("trend intact"))
    return _finish(found, "high_52w", C("close"), F.greatest(C("sma_50") * 0.97, C("high_252") * 0.95), F.when(below > 0, 30).when(below > -1, 27).otherwise(24), told)


def strongest(bars: DataFrame, share: float = 0.15) -> DataFrame:
    """The tickers of each date with the best three-month returns: the given share of them, at least one."""
    w = Window.partitionBy("d")
    ranked = bars.where("n_bars >= 63 and return_63 is not null").withColumns({"_n": F.row_number().over(w.orderBy(F.desc("return_63"), "ticker")), "_of": F.count("*").over(w)})
    return ranked.where(C("_n") <= F.greatest(F.lit(1), F.floor(share * C("_of")))).drop("_n", "_of")


def csm(bars: DataFrame) -> DataFrame:
    """Cross-sectional momentum among the strongest tickers of a date."""
    ret, rsi, adx, vr = C("return_63"), C("rsi_14"), C("adx_14"), C("volume_ratio")
    found = strongest(bars).where(passes(C("close") <= C("sma_50"), (rsi < 40) | (rsi > 75), adx < 10, vr < 0.8, ret <= 0))
    lead = F.when(ret > 30, "Top performer +").when(ret > 20, "Strong performer +").otherwise("Outperforming +")
    told = phrase(F.concat(lead, F.format_string("%.0f", ret), F.lit("% in 3M")), F.when(vr > 1.5, "volume confirming").otherwise("normal volume"), F.when(adx > 25, "powerful trend").otherwise("trend intact"))
    return _finish(found, "csm", C("close"), C("sma_50") * 0.97, clip(ret, 10.0, 30.0), told)


SCANS = {"pullback": pullback, "trend": trend, "mean_reversion": mean_reversion, "sector": sector, "pead": pead, "high_52w": high_52w, "csm": csm}


def active(strategy: str) -> Column:
    """Whether a bar's regime runs the strategy (an unknown regime runs the pullback scan only)."""
    regimes = [r for r, names in REGIMES.items() if strategy in names]
    known = C("regime").isin(regimes)
    return known | ~F.coalesce(C("regime").isin(list(REGIMES)), F.lit(False)) if strategy == "pullback" else known


def scan_all(bars: DataFrame) -> DataFrame:
    """The union of all scans that each bar's regime runs."""
    return reduce(DataFrame.unionByName, [SCANS[s](bars).where(active(s)) for s in ORDER])
