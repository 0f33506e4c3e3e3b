"""From ranked candidates to the rows that a nightly run stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import calendar, ranking, sizing

C = F.col
#: A candidate's fields in order, with kinds and defaults (targets and the reason have none).
CANDIDATE = {
    "scan_date": ("string", ""), "ticker": ("string", ""), "company_name": ("string", ""), "industry": ("string", ""), "price": ("double", 0.0), "entry_price": ("double", 0.0),
    "stop_loss": ("double", 0.0), "exit_price": ("double", 0.0), "upside_pct": ("double", 0.0), "risk_reward": ("double", 0.0), "current_rsi": ("double", 0.0), "volume_ratio": ("double", 0.0),
    "adx_value": ("double", 0.0), "macd_histogram": ("double", 0.0), "rsi_min_10d": ("double", 0.0), "ema20": ("double", 0.0), "narrative": ("string", ""), "strategy": ("string", ""),
    "strategy_name": ("string", ""), "tier_label": ("string", "Unrated"), "composite_score": ("double", 0.0), "quality_score": ("double", 0.0), "score": ("double", 0.0), "regime": ("string", "bull"),
    "is_fallback": ("boolean", False), "past_win_rate": ("double", 0.0), "expectancy_pct": ("double", 0.0), "total_trades": ("int", 0), "wins": ("int", 0), "losses": ("int", 0),
    "target_1": ("double", None), "target_2": ("double", None), "target_3": ("double", None), "target_1_pct": ("double", 0.0), "target_2_pct": ("double", 0.0), "target_3_pct": ("double", 0.0),
    "weighted_rr": ("double", 0.0), "position_sizing": ("string", "50/30/20"), "context_score": ("double", 0.0), "context_analyst": ("double", 0.0), "context_earnings": ("double", 0.0),
    "context_fundamental": ("double", 0.0), "context_news": ("double", 0.0), "is_blocked": ("boolean", False), "blocked_reason": ("string", None),
}
ALSO = {"past_win_rate": "win_rate", "scan_date": "d"}  # other names of fields; the win rate's goes first


def candidates(rows: DataFrame) -> DataFrame:
    """Any rows in the candidate schema: missing columns, unreadable values and nulls become defaults; others are left out.

    A candidate is never blocked: blocked signals are dropped before.
    """
    def field(name: str, kind: str, default) -> F.Column:
        names = [n for n in (ALSO.get(name), name) if n in rows.columns] if name not in ("is_blocked", "blocked_reason") else []
        return F.coalesce(*(C(n).try_cast(kind) for n in names), F.lit(default).cast(kind)).alias(name)

    return rows.select(*(field(n, k, d) for n, (k, d) in CANDIDATE.items()))


def compatible(pool: DataFrame) -> DataFrame:
    """Scores for callers of the old ranker, which knew neither means nor MACD nor regimes."""
    return ranking.scores(pool.withColumns({"dma_50": C("price"), "macd_hist": F.lit(0.0), "regime": F.lit("bull")}))


def with_context(scored: DataFrame, context: DataFrame) -> DataFrame:
    """Composites again with context scores, for the rows that were ranked without any (zero counts as none)."""
    late = context.select("ticker", C("context_score").alias("_late"))
    own = F.when(C("context_score") != 0, C("context_score")) if "context_score" in scored.columns else F.lit(None).cast("double")
    rows = scored.drop("preliminary", "rank_score").join(late, "ticker", "left").withColumn("context_score", F.coalesce(own, "_late", F.lit(0.0))).drop("_late")
    return ranking.scores(rows)


def without_open(signals: DataFrame, positions: DataFrame) -> DataFrame:
    """Signals of tickers that are not already an open position; ``positions`` has ``ticker`` and the ``d`` on which it is open."""
    held = positions.select(F.upper("ticker").alias("_ticker"), C("d").alias("_d")).distinct()
    return signals.join(held, (F.upper("ticker") == C("_ticker")) & (C("d") == C("_d")), "left_anti")


def recommended(signals: DataFrame, portfolio_value: float, cash: float, multiplier: float = 1.0, positions: DataFrame | None = None) -> DataFrame:
    """The best three of each date's unblocked signals, without tickers already held, stops within the ceiling, sized, pending, to be entered on the next trading day."""
    best = ranking.quality_gate(ranking.best_of_ticker(ranking.by_strategy(signals)))
    if positions is not None:
        best = without_open(best, positions)
    best = sizing.ceiling(best if "atr" in best.columns else best.withColumn("atr", F.lit(0.0)))
    sized = best.withColumns({"fraction": sizing.half_kelly(C("composite_score"), C("weighted_rr")) * multiplier * (C("size_mult") if "size_mult" in best.columns else F.lit(1.0)), "portfolio_value": F.lit(portfolio_value), "cash": F.lit(cash)})
    rows = sizing.normalised(sized, "d")
    return rows.withColumns({"entry_date": calendar.next_trading_day(C("d")), "status": F.lit("pending")}).drop("wanted", "fraction", "portfolio_value", "cash")


def history_rollup(history: DataFrame) -> DataFrame:
    """Rated and unrated signals of each date, and the mean return of the rated."""
    return history.groupBy("d").agg(F.count("outcome").alias("rated"), F.count(F.when(C("outcome").isNull(), 1)).alias("unrated"), F.round(F.avg("return_pct") + 1e-8, 4).alias("mean_return"))
