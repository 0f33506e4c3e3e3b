"""Scores of a candidate pool, tiers, caps and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, percentile_rank, sigmoid
from tickloom.operators.strategies import CAPS, ORDER

C = F.col
POOL = ("strategy", "d")
MOST = 50  # of a scan without a cap of its own
#: Weights of momentum, expectancy, win rate, regime and context.
WEIGHTS = {"bull": (0.30, 0.30, 0.15, 0.10, 0.15), "sideways": (0.25, 0.35, 0.15, 0.10, 0.15), "bear": (0.15, 0.35, 0.10, 0.10, 0.30)}
DEFENSIVE = ("Utilities", "Consumer Staples", "Health Care", "Insurance", "Telecommunication Services")


def raw_momentum() -> Column:
    rsi = clip(100 - 4 * F.abs(C("current_rsi") - 50), 0.0, 100.0)
    near = clip(100 - 500 * F.abs(C("price") / C("dma_50") - 1), 0.0, 100.0)
    return (rsi + near + clip(50 * C("volume_ratio"), 0.0, 100.0) + clip(50 + 200 * C("macd_hist"), 0.0, 100.0)) / 4


def regime_score(beta: Column | None = None) -> Column:
    """100 where a stock suits the regime, else 0; in a bear regime defensive industries do, and betas under 1 (unknown counts as 1)."""
    defensive = F.coalesce(beta < 1, F.lit(False)) if beta is not None else F.lit(False)
    for name in DEFENSIVE:
        defensive = defensive | F.coalesce(F.trim(C("industry")).contains(name), F.lit(False))
    suits = F.when(C("regime") == "bull", C("current_rsi").between(50, 70) & (C("price") > C("dma_50"))).when(C("regime") == "bear", defensive).when(C("regime") == "sideways", F.abs(C("current_rsi") - 50) < 8)
    return F.when(F.coalesce(suits, F.lit(False)), 100.0).otherwise(0.0)


def weight(k: int) -> Column:
    out = F.when(C("regime") == "bull", WEIGHTS["bull"][k]).when(C("regime") == "bear", WEIGHTS["bear"][k])
    return out.otherwise(WEIGHTS["sideways"][k])


def scores(pool: DataFrame) -> DataFrame:
    """Momentum, expectancy, win-rate and regime scores, relative to each pool (strategy and date), and the composite."""
    w = Window.partitionBy(*POOL)
    pool = pool.withColumn("raw_momentum", raw_momentum())
    deviation = F.stddev_samp("expectancy_pct").over(w)
    z = F.when(F.coalesce(deviation, F.lit(0.0)) < 1e-4, 0.0).otherwise((C("expectancy_pct") - F.avg("expectancy_pct").over(w)) / deviation)
    pool = pool.withColumns({"_z": z, "momentum_score": percentile_rank(C("raw_momentum"), *POOL) * sigmoid((C("raw_momentum") - 55) / 5)})
    curve = 100 * sigmoid(C("_z"))
    pool = pool.withColumns({
        "expectancy_score": F.when(C("expectancy_pct") < 0, F.greatest(F.lit(5.0), curve - 30)).otherwise(curve),
        "winrate_score": percentile_rank(C("win_rate"), *POOL),
        "regime_score": regime_score(C("beta") if "beta" in pool.columns else None),
    }).drop("_z")
    context = F.coalesce(C("context_score"), F.lit(0.0)) if "context_score" in pool.columns else F.lit(0.0)
    parts = [C("momentum_score"), C("expectancy_score"), C("winrate_score"), C("regime_score"), context]
    composite = weight(0) * parts[0]
    for k in range(1, 5):
        composite = composite + weight(k) * parts[k]
    early = 0.3 * parts[0] + 0.4 * parts[1] + 0.2 * parts[2] + 0.1 * parts[3]
    return pool.withColumns({"preliminary": F.round(early, 4), "rank_score": F.round(composite, 4)})


def top(pool: DataFrame, k: int, by: str, *partition: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(F.desc(by), "ticker")
    return pool.withColumn("place", F.row_number().over(w)).where(C("place") <= k)


def tier(context: Column | None = None) -> Column:
    """1 to 4 by score, expectancy, win rate and trades."""
    context = F.lit(0.0) if context is None else context
    s, e, wr, n = C("rank_score"), C("expectancy_pct"), C("win_rate"), C("total_signals")
    first = (s >= F.when(C("regime") == "bull", 80).otherwise(75)) & ((C("regime") != "bear") | (context > 50)) & (e > 0) & (wr >= 35) & (n >= 10)
    return F.when(first, 1).when((s >= 50) & (e >= 0) & (wr >= 25) & (n >= 10), 2).when((s >= 40) & (e >= -2), 3).otherwise(4)


def tiered(scored: DataFrame) -> DataFrame:
    """Tiers 1 and 2 of every pool in order: by tier first where there are three of tier 1, else by score.

    In a bear regime only a context score, where there is one, opens tier 1.
    """
    context = F.coalesce(C("context_score"), F.lit(0.0)) if "context_score" in scored.columns else None
    kept = scored.withColumn("tier", tier(context)).where("tier <= 2")
    kept = kept.withColumn("_firsts", F.count(F.when(C("tier") == 1, 1)).over(Window.partitionBy(*POOL)))
    order = Window.partitionBy(*POOL).orderBy(F.when(C("_firsts") >= 3, C("tier")).otherwise(0), F.desc("rank_score"), "ticker")
    return kept.withColumn("place", F.row_number().over(order)).drop("_firsts")


def by_strategy(signals: DataFrame) -> DataFrame:
    """What each scan hands on for a date: unblocked signals in its own order, up to its cap.

    Most scans order by composite score; cross-sectional momentum by three-month
    return first, and of equal earnings drifts the more recent one leads.
    """
    of_momentum, of_drift = C("strategy") == "csm", C("strategy") == "pead"
    then = F.when(of_momentum, -C("composite_score")).when(of_drift, F.coalesce("days_since", F.lit(5)).cast("double")).otherwise(0.0)
    order = Window.partitionBy(*POOL).orderBy(F.desc(F.when(of_momentum, F.coalesce("returns_3m", F.lit(0.0))).otherwise(C("composite_score"))), then, "ticker")
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CAPS.items() for x in pair)), C("strategy")), F.lit(MOST))
    return signals.where("guard_reason is null").withColumn("scan_place", F.row_number().over(order)).where(C("scan_place") <= cap)


def registry_place() -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in ORDER)), C("strategy"))


def best_of_ticker(signals: DataFrame) -> DataFrame:
    """One signal per date and ticker: the best quality, then the earlier scan."""
    w = Window.partitionBy("d", "ticker").orderBy(F.desc("quality_score"), registry_place())
    return signals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quality_gate(signals: DataFrame, bar: float = 80, k: int = 3) -> DataFrame:
    """Of each date, the signals that reach ``bar`` if any does, else all; the top ``k`` of them."""
    best = F.max("composite_score").over(Window.partitionBy("d"))
    kept = signals.withColumn("_best", best).where((C("_best") < bar) | (C("composite_score") >= bar)).drop("_best")
    return top(kept, k, "composite_score", "d")
