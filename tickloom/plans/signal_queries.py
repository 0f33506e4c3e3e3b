"""Queries over regimes, scans, ranking and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import backtest, context, indicators, joins, ranking, regime, strategies
from tickloom.plans import oracle
from tickloom.plans.indicator_queries import C, query
from tickloom.sources import market, shared

CTE = oracle.CTE

CTE["earn"] = """SELECT b.ticker, b.d - CAST(1 + u.n % 5 AS INTEGER) AS earnings_date, round(1 + b.t % 7 * 0.1e0, 2) AS actual, round(b.t % 5 * 0.1e0, 2) AS estimate,
  CASE WHEN b.t % 26 = 5 THEN round((b.t % 11) * 1.5e0 - 6, 2) END AS surprise FROM (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 >= 0.02e0, false) AS jump FROM bars) b JOIN universe u ON b.ticker = u.ticker WHERE b.t % 13 = 5 OR jump"""
CTE["regimes"] = f"""SELECT d, close, CASE WHEN far IS NULL OR far > 0.02e0 THEN 'bull' WHEN far < -0.02e0 THEN 'bear' ELSE 'sideways' END AS regime
  FROM (SELECT d, close, close / (CASE WHEN t >= 199 THEN avg(close) {oracle.w(200)} END) - 1 AS far FROM idx)"""
#: Before the scans, which run on it.
CTE["overridden"] = "SELECT r.d, CASE WHEN coalesce(vix > 40, false) THEN 'bear' ELSE regime END AS regime, CASE WHEN coalesce(vix > 40, false) THEN 0.5e0 ELSE 1e0 END AS size_mult FROM regimes r LEFT JOIN vix v ON r.d = v.d"
CTE["wide_sig"] = """SELECT *, round(entry + 3 * (entry - stop), 2) AS target FROM (SELECT ticker, d, t, round(high * 1.001e0, 2) AS entry, swing_low AS stop FROM (SELECT *, max(t) OVER (PARTITION BY ticker) AS last FROM ind)
  WHERE t >= 200 AND t <= last - 1 AND swing_low IS NOT NULL AND close > dma_50 AND dma_50 > dma_200) WHERE stop < entry"""
CTE["wide_trades"] = oracle.trades("wide_sig")
CTE["wide"] = f"SELECT ticker, {oracle.METRICS} FROM wide_trades GROUP BY ticker"
CTE["scanned"] = """SELECT i.*, u.industry, u.is_etf, r.regime, r.size_mult, coalesce(m.win_rate, 0e0) AS win_rate, coalesce(m.expectancy_pct, 0e0) AS expectancy_pct, coalesce(m.total_signals, 0) AS total_signals,
  e.days_since, n.days_to_earnings FROM ind i JOIN universe u ON i.ticker = u.ticker JOIN overridden r ON i.d = r.d LEFT JOIN wide m ON i.ticker = m.ticker
  LEFT JOIN (SELECT i.ticker, i.d, CASE WHEN i.d - max(e.earnings_date) BETWEEN 1 AND 5 THEN CAST(i.d - max(e.earnings_date) AS INTEGER) END AS days_since FROM bars i JOIN earn e ON i.ticker = e.ticker AND e.earnings_date <= i.d GROUP BY 1, i.d) e
    ON i.ticker = e.ticker AND i.d = e.d
  LEFT JOIN (SELECT i.ticker, i.d, CAST(min(e.earnings_date) - i.d AS INTEGER) AS days_to_earnings FROM bars i JOIN earn e ON i.ticker = e.ticker AND e.earnings_date > i.d GROUP BY 1, i.d) n
    ON i.ticker = n.ticker AND i.d = n.d"""


def bars_with_indicators(spark, sf_dir) -> DataFrame:
    """All bars and indicators, written once for a plan that reads them several times, in buckets by ticker."""
    return shared.bucketed(indicators.all_indicators(market.bars(spark, sf_dir)), "indicators", "ticker")


def wide_metrics(found: DataFrame) -> DataFrame:
    """Ticker metrics of the trend-only backtest, which has trades enough for the gates."""
    trades = backtest.simulate(backtest.signals(found, use=("trend",)), found)
    return backtest.metrics(trades, "ticker").select("ticker", "win_rate", "expectancy_pct", "total_signals", "wins", "losses")


def scan_input(spark, sf_dir, found: DataFrame | None = None, vix: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Bars with indicators, universe, regime, metrics and days around earnings.

    The regime is overridden where the volatility index is over 40 (``vix``, by
    default the index's own): bear, with half sizes.
    """
    found = bars_with_indicators(spark, sf_dir) if found is None else found
    metrics = wide_metrics(found) if metrics is None else metrics
    universe = market.universe(spark, sf_dir)
    reports = market.earnings(found, universe)
    rows = joins.as_of(found, reports, "ticker", "d", "earnings_date", ["earnings_date"]).withColumnRenamed("earnings_date", "_last")
    rows = joins.as_of(rows, reports, "ticker", "d", "earnings_date", ["earnings_date"], forward=True).withColumnRenamed("earnings_date", "_next")
    since = F.datediff("d", "_last")
    rows = rows.withColumns({"days_since": F.when(since.between(1, 5), since), "days_to_earnings": F.datediff("_next", "d")}).drop("_last", "_next")
    index = market.index_bars(found)
    regimes = regime.vix_override(regime.sma_regime(index), market.volatility_index(index) if vix is None else vix)
    rows = rows.join(universe.select("ticker", "industry", "is_etf"), "ticker").join(regimes, "d").join(metrics.drop("wins", "losses"), "ticker", "left")
    return rows.withColumns({c: F.coalesce(C(c), F.lit(0.0)) for c in ("win_rate", "expectancy_pct")} | {"total_signals": F.coalesce(C("total_signals"), F.lit(0))})


@query("SELECT d, close, regime FROM regimes")
def regime_sma(spark, sf_dir):
    return regime.sma_regime(market.index_bars(market.bars(spark, sf_dir)))



@query("SELECT * FROM overridden")
def regime_vix_override(spark, sf_dir):
    index = market.index_bars(market.bars(spark, sf_dir))
    return regime.vix_override(regime.sma_regime(index), market.volatility_index(index))


@query(" UNION ALL ".join(f"SELECT d, '{s}' AS strategy FROM regimes WHERE regime IN ({', '.join(repr(r) for r, names in strategies.REGIMES.items() if s in names)})" for s in strategies.ORDER))
def regime_strategy_map(spark, sf_dir):
    """The strategies that each date's regime runs."""
    dates = regime_sma(spark, sf_dir)
    return dates.select("d", F.explode(F.array_compact(F.array(*(F.when(strategies.active(s), F.lit(s)) for s in strategies.ORDER)))).alias("strategy"))


@query("SELECT d, 'swing_momentum' AS kind, regime = 'bull' AS trade FROM regimes UNION ALL SELECT d, 'other', true FROM regimes")
def regime_should_trade(spark, sf_dir):
    kinds = regime_sma(spark, sf_dir).select("d", "regime", F.explode(F.array(F.lit("swing_momentum"), F.lit("other"))).alias("kind"))
    return kinds.select("d", "kind", regime.should_trade(C("kind"), C("regime")).alias("trade"))


def _hmm_features(spark, sf_dir):
    """Features of the whole market's index and of each industry's, all with the market's volatility."""
    bars = shared.written(market.bars(spark, sf_dir).join(market.universe(spark, sf_dir).select("ticker", "industry"), "ticker"), "bars")
    index = market.index_bars(bars)
    series = index.unionByName(market.index_bars(bars, "industry"))
    return shared.written(indicators.hmm_features(series, market.volatility_index(index)), "hmm_features")


@query(None)
def hmm_regime(spark, sf_dir):
    return regime.hmm_regime(_hmm_features(spark, sf_dir))


@query(None)
def hmm_models(spark, sf_dir):
    return regime.hmm_models(_hmm_features(spark, sf_dir))


@query(None)
def hmm_stored_regime(spark, sf_dir):
    """The regime by the parameters table, written and read again."""
    features = _hmm_features(spark, sf_dir)
    return regime.hmm_stored_regime(features, shared.written(regime.hmm_models(features), "hmm_models"))


# --- scans, in SQL written from the rules -----------------------------------------------------------

_EXP = {True: "WHEN expectancy_pct >= -5 THEN 5 ELSE 0", False: "ELSE 5"}
_WIN = {"a": "WHEN win_rate >= 40 THEN 10 WHEN win_rate >= 25 THEN 5 ELSE 0", "b": "WHEN win_rate >= 40 THEN 10 ELSE 5", "c": "ELSE 5"}
_OVER200, _LOW = "(close / sma_200 - 1) * 100", "(close / low_20 - 1) * 100"
_52 = "(close / high_252 - 1) * 100"


def _said(*parts: str) -> str:
    return f"concat_ws(', ', {', '.join(f'CASE {p} END' for p in parts)}) || '.'"


_ADX = "WHEN adx_14 > 25 THEN 'powerful trend' ELSE 'trend intact'"
#: Source, gates that must hold, stop, momentum points, narrative, expectancy low, win low, extra columns for risk.
_SCAN = {
    "trend": ("scanned", "n_bars >= 200 AND NOT coalesce(close <= sma_200 * 1.02e0, false) AND NOT coalesce(from_high_20 > 5, false) AND cs",
              "CASE WHEN atr_14 > 0 THEN greatest(low_10, close - 2.5e0 * atr_14) ELSE greatest(low_10, sma_200 * 0.98e0) END",
              f"CASE WHEN {_OVER200} > 15 THEN 30 WHEN {_OVER200} > 10 THEN 25 WHEN {_OVER200} > 5 THEN 20 WHEN {_OVER200} > 2 THEN 15 ELSE 10 END",
              _said(f"WHEN {_OVER200} > 10 THEN 'Strong uptrend' WHEN {_OVER200} > 5 THEN 'Rising trend' ELSE 'Above 200 DMA'", "WHEN volume_ratio > 1.5e0 THEN 'strong volume' WHEN volume_ratio > 1.2e0 THEN 'volume confirming'",
                    "WHEN rsi_14 > 70 THEN 'strong momentum' WHEN rsi_14 > 60 THEN 'momentum building'", "WHEN adx_14 > 25 THEN 'powerful trend' WHEN adx_14 > 20 THEN 'trend intact'"), True, "a"),
    "mean_reversion": ("scanned", f"n_bars >= 50 AND NOT coalesce(rsi_14 >= 40, false) AND NOT coalesce(rsi_min_5 > 35, false) AND NOT coalesce({_LOW} > 8, false) AND NOT coalesce(volume_ratio < 0.8e0, false) AND NOT coalesce(adx_14 > 40, false) AND NOT coalesce(bb_position > 0.35e0, false)",
                       "low_20 * 0.98e0", "CASE WHEN rsi_14 < 20 THEN 30 WHEN rsi_14 < 25 THEN 27 WHEN rsi_14 < 30 THEN 24 WHEN rsi_14 < 35 THEN 20 ELSE 15 END",
                       _said(f"WHEN {_LOW} < 1 THEN 'At 20-day low' WHEN {_LOW} < 3 THEN 'Near 20-day low' ELSE 'Bouncing from support'", "WHEN rsi_14 < 25 THEN 'deeply oversold' WHEN rsi_14 < 30 THEN 'oversold bounce' ELSE 'recovering RSI'",
                             "WHEN volume_ratio > 1.5e0 THEN 'strong volume on bounce' WHEN volume_ratio > 1.2e0 THEN 'volume confirming bounce' ELSE 'normal volume'", "WHEN bb_position < 0.1e0 THEN 'at lower Bollinger Band' WHEN bb_position < 0.2e0 THEN 'near lower band'"), True, "a"),
    "sector": ("funds", "is_etf AND n_bars >= 60 AND NOT coalesce(close <= sma_50, false) AND NOT coalesce(close <= sma_200, false) AND NOT coalesce(rsi_14 < 45 OR rsi_14 > 80, false) AND NOT coalesce(adx_14 < 12, false) AND NOT coalesce(volume_ratio < 0.8e0, false) AND NOT coalesce(from_high_20 > 5, false)",
               "sma_50 * 0.97e0", f"CASE WHEN {_OVER200} > 15 THEN 30 WHEN {_OVER200} > 10 THEN 27 WHEN {_OVER200} > 5 THEN 24 WHEN {_OVER200} > 0 THEN 20 ELSE 15 END",
               "industry || ': ' || " + _said(f"WHEN {_OVER200} > 10 THEN 'Leading sector' WHEN {_OVER200} > 5 THEN 'Strong sector' ELSE 'Sector uptrend'", "WHEN rsi_14 > 65 THEN 'strong momentum' ELSE 'momentum building'",
                                               "WHEN volume_ratio > 1.3e0 THEN 'heavy volume' WHEN volume_ratio > 1.1e0 THEN 'volume confirming'", _ADX), False, "b"),
    "pead": ("drift", "days_since IS NOT NULL AND n_bars >= 60 AND coalesce(best_5 >= 0.02e0, false) AND NOT coalesce(gap < 2, false) AND NOT coalesce(hold < 0.3e0, false) AND NOT coalesce((close / ghigh - 1) * 100 < -5, false) AND NOT coalesce(close <= sma_50, false) AND NOT coalesce(gvol < vavg * 1.5e0, false) AND NOT coalesce(adx_14 < 10, false)",
             "greatest(sma_50 * 0.98e0, glow * 1.02e0)", "CASE WHEN gap >= 10 THEN 30 WHEN gap >= 7 THEN 27 WHEN gap >= 5 THEN 24 ELSE 20 END - CASE WHEN hold >= 0.8e0 THEN 0 WHEN hold >= 0.6e0 THEN 2 ELSE 5 END",
             _said("WHEN true THEN 'Earnings gap +' || printf('%.1f', gap) || '% ' || days_since || 'd ago'", "WHEN hold > 0.8e0 THEN 'holding strong' WHEN hold > 0.6e0 THEN 'holding most gains' ELSE 'pulling back to support'",
                   "WHEN CASE WHEN vavg > 0 THEN gvol / vavg ELSE 0 END > 3 THEN 'massive volume' WHEN CASE WHEN vavg > 0 THEN gvol / vavg ELSE 0 END > 2 THEN 'strong volume'"), False, "b"),
    "high_52w": ("scanned", f"n_bars >= 252 AND NOT coalesce({_52} < -5, false) AND NOT coalesce(close <= sma_50, false) AND NOT coalesce(rsi_14 < 45 OR rsi_14 > 80, false) AND NOT coalesce(adx_14 < 15, false) AND NOT coalesce(volume_ratio < 0.8e0, false) AND NOT coalesce(from_high_20 > 5, false)",
                 "greatest(sma_50 * 0.97e0, high_252 * 0.95e0)", f"CASE WHEN {_52} > 0 THEN 30 WHEN {_52} > -1 THEN 27 ELSE 24 END",
                 _said(f"WHEN {_52} > -0.5e0 THEN 'At 52-week high' ELSE 'Near 52-week high'", "WHEN volume_ratio > 2 THEN 'massive breakout volume' WHEN volume_ratio > 1.5e0 THEN 'strong breakout volume' ELSE 'volume confirming'", _ADX), False, "c"),
    "csm": ("strong", "NOT coalesce(close <= sma_50, false) AND NOT coalesce(rsi_14 < 40 OR rsi_14 > 75, false) AND NOT coalesce(adx_14 < 10, false) AND NOT coalesce(volume_ratio < 0.8e0, false) AND NOT coalesce(return_63 <= 0, false)",
            "sma_50 * 0.97e0", "least(greatest(return_63, 10e0), 30e0)",
            _said("WHEN true THEN CASE WHEN return_63 > 30 THEN 'Top performer +' WHEN return_63 > 20 THEN 'Strong performer +' ELSE 'Outperforming +' END || printf('%.0f', return_63) || '% in 3M'", "WHEN volume_ratio > 1.5e0 THEN 'volume confirming' ELSE 'normal volume'", _ADX), False, "c"),
    "pullback": ("gated", "failed IS NULL", "swing_low", "0",
                 _said("WHEN NOT coalesce(ema_20 > 0, false) THEN 'Trend unclear' WHEN (close / ema_20 - 1) * 100 > 5 THEN 'Strong uptrend' WHEN (close / ema_20 - 1) * 100 > 2 THEN 'Rising trend' WHEN (close / ema_20 - 1) * 100 > -1 THEN 'At support' ELSE 'Pullback to support'",
                       "WHEN volume_ratio > 1.3e0 THEN 'strong volume' WHEN volume_ratio > 1.05e0 THEN 'volume confirming' WHEN volume_ratio > 0.9e0 THEN 'normal volume' ELSE 'light volume'",
                       "WHEN rsi_14 < 30 THEN 'deeply oversold' WHEN rsi_14 < 40 THEN 'oversold bounce' WHEN rsi_14 < 48 THEN 'recovering' WHEN rsi_14 < 55 THEN 'neutral RSI' WHEN rsi_14 < 62 THEN 'momentum building' WHEN rsi_14 < 70 THEN 'strong momentum' ELSE 'overbought'"), None, None),
}
CTE["agreed"] = "SELECT s.*, c.consensus AS cs FROM scanned s JOIN cons c ON s.ticker = c.ticker AND s.d = c.d"
CTE["funds"] = """SELECT * REPLACE (CASE WHEN total_signals = 0 THEN 55e0 ELSE win_rate END AS win_rate, CASE WHEN total_signals = 0 THEN 2e0 ELSE expectancy_pct END AS expectancy_pct,
  CASE WHEN total_signals = 0 THEN 5 ELSE total_signals END AS total_signals) FROM scanned"""
CTE["strong"] = """SELECT * FROM scanned WHERE n_bars >= 63 AND return_63 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY return_63 DESC, ticker) <= greatest(1, floor(0.15e0 * count(*) OVER (PARTITION BY d)))"""


def _pick(text: str) -> str:
    return "CASE days_since " + " ".join(f"WHEN {k} THEN {text.format(k=k, b=k - 1)}" for k in range(1, 6)) + " END"


CTE["drift0"] = f"""SELECT *, {_pick('lag(close, {b}) ' + oracle.T)} AS gclose, {_pick('lag(close, {k}) ' + oracle.T)} AS gprev, {_pick('lag(volume, {b}) ' + oracle.T)} AS gvol,
  {_pick('max(high) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {b} PRECEDING AND CURRENT ROW)')} AS ghigh, {_pick('min(low) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {b} PRECEDING AND CURRENT ROW)')} AS glow,
  CASE WHEN t >= 19 THEN volume_ma_20 END AS vavg FROM scanned"""
CTE["drift"] = "SELECT *, CASE WHEN gprev > 0 THEN (gclose / gprev - 1) * 100 ELSE 0e0 END AS gap, CASE WHEN ghigh > glow THEN (close - glow) / (ghigh - glow) ELSE 1e0 END AS hold FROM drift0"
_RISK = "(round(high * 1.001e0, 2) - swing_low) / round(high * 1.001e0, 2) * 100"
CTE["gated"] = f"""SELECT *, CASE WHEN n_bars < 201 THEN 'history' WHEN dma_50 IS NULL OR dma_200 IS NULL OR rsi_14 IS NULL OR rsi_min_10 IS NULL OR adx_14 IS NULL OR volume_ratio IS NULL THEN 'invalid'
  WHEN close <= dma_50 OR (regime <> 'bull' AND dma_50 <= dma_200) THEN 'trend'
  WHEN CASE WHEN close >= dma_50 * 1.2e0 AND volume_ratio >= 1.5e0 AND adx_14 >= 20 THEN rsi_14 > 75 ELSE rsi_min_10 >= 55 OR rsi_14 < 35 OR rsi_14 > 70 END THEN 'rsi'
  WHEN adx_14 < CASE WHEN regime = 'bull' THEN 15 ELSE 18 END THEN 'adx' WHEN round(volume_ratio, 2) < 0.8e0 THEN 'volume'
  WHEN swing_low IS NULL OR swing_low >= round(high * 1.001e0, 2) THEN 'swing_low' WHEN {_RISK} > 15 THEN 'maxrisk' WHEN {_RISK} < 2.5e0 THEN 'minrisk' WHEN worst_5 * 100 < -5 THEN 'maxgap'
  WHEN total_signals < 10 THEN 'trades' WHEN days_to_earnings > 0 AND days_to_earnings <= 7 THEN 'earnings' END AS failed FROM scanned"""


def percent_up(price: str, p: int) -> str:
    return f"CAST((CAST(round({price} * 100) AS BIGINT) * {100 + p} + 50) // 100 AS DOUBLE) / 100"


def _scan_sql(name: str) -> str:
    source, gates, stop, momentum, told, low_exp, low_win = _SCAN[name]
    source = "agreed" if name == "trend" else source
    targets, _, least, factor = strategies.RULES[name]
    entry = "round(high * 1.001e0, 2)" if name == "pullback" else "close"
    if name == "pullback":
        points = "0"
        reason = """nullif(concat_ws('; ', CASE WHEN win_rate < 35 THEN 'low win rate' END, CASE WHEN expectancy_pct < 0 THEN 'negative expectancy' END, CASE WHEN total_signals < 5 THEN 'few trades' END), '')"""
    else:
        bull, side, other = strategies.REGIME_POINTS[name]
        points = f"""(CASE WHEN expectancy_pct >= 10 THEN 40 WHEN expectancy_pct >= 5 THEN 35 WHEN expectancy_pct >= 2 THEN 25 WHEN expectancy_pct >= 0 THEN 15 {_EXP[low_exp]} END
          + CASE WHEN win_rate >= 70 THEN 20 WHEN win_rate >= 60 THEN 17 WHEN win_rate >= 50 THEN 14 {_WIN[low_win]} END + CASE regime WHEN 'bull' THEN {bull} WHEN 'sideways' THEN {side} ELSE {other} END)"""
        reason = f"CASE WHEN total_signals < {least} THEN 'few trades' WHEN expectancy_pct < 1 THEN 'low expectancy' WHEN win_rate < 50 THEN 'low win rate' END"
    risk = 0 if name == "pullback" else 2.5
    quality = "0e0" if name == "pullback" else f"round(CASE WHEN guard_reason IS NOT NULL THEN composite_score * {factor!r}e0 ELSE composite_score END, 4)"
    t = [percent_up("entry_price", p) for p in targets]
    return f"""SELECT '{name}' AS strategy, ticker, d, close AS price, entry_price, stop_loss, target_1, target_2, target_3, round((target_1 / entry_price - 1) * 100, 4) AS upside_pct,
  round(CASE WHEN entry_price > stop_loss THEN (0.5e0 * (target_1 - entry_price) + 0.3e0 * (target_2 - entry_price) + 0.2e0 * (target_3 - entry_price)) / (entry_price - stop_loss) ELSE 0e0 END, 4) AS weighted_rr,
  round(rsi_14, 4) AS current_rsi, round(volume_ratio, 4) AS volume_ratio, round(adx_14, 4) AS adx_value, CAST(momentum AS DOUBLE) AS momentum_pts, composite_score,
  CASE WHEN guard_reason IS NOT NULL THEN 'Blocked' WHEN composite_score >= 70 THEN 'Strong Buy' WHEN composite_score >= 50 THEN 'Buy' WHEN composite_score >= 35 THEN 'Watch' ELSE 'Speculative' END AS tier_label,
  guard_reason, {quality} AS quality_score, narrative, round(return_63, 4) AS returns_3m, days_since, regime, size_mult
  FROM (SELECT *, round(CAST(momentum AS DOUBLE) + {points}, 4) AS composite_score, {reason} AS guard_reason, {t[0]} AS target_1, {t[1]} AS target_2, {t[2]} AS target_3
    FROM (SELECT *, round({entry} + 1e-9, 2) AS entry_price, round({stop} + 1e-9, 2) AS stop_loss, {momentum} AS momentum, {told} AS narrative FROM {source} WHERE {gates}))
  WHERE NOT coalesce((entry_price - stop_loss) / entry_price * 100 < {risk}e0, false)"""


def _add_scan(name: str) -> None:
    CTE[f"s_{name}"] = _scan_sql(name)

    def run(spark, sf_dir):
        return strategies.SCANS[name](scan_input(spark, sf_dir))

    run.__name__ = f"scan_{name}"
    query(f"SELECT * FROM s_{name}")(run)


for _name in strategies.ORDER:
    _add_scan(_name)

CTE["all_signals"] = " UNION ALL ".join(f"SELECT * FROM s_{s} WHERE regime IN ({', '.join(repr(r) for r, n in strategies.REGIMES.items() if s in n)})" for s in strategies.ORDER)


@query("SELECT * FROM all_signals")
def scan_union(spark, sf_dir):
    """All scans that the regimes run."""
    return signals(spark, sf_dir)


def signals(spark, sf_dir, found: DataFrame | None = None, vix: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    return strategies.scan_all(shared.bucketed(scan_input(spark, sf_dir, found, vix, metrics), "scan", "ticker"))  # read by seven scans


@query("SELECT d, ticker, round(return_63, 6) AS return_63 FROM strong")
def screen_csm_top15(spark, sf_dir):
    return strategies.strongest(indicators.all_indicators(market.bars(spark, sf_dir))).select("d", "ticker", F.round("return_63", 6).alias("return_63"))


@query("SELECT d, coalesce(failed, 'passed') AS gate, count(*) AS tickers, round(count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY d), 2) AS pct FROM gated GROUP BY 1, 2")
def scan_gate_rejections(spark, sf_dir):
    """How many tickers each gate of the pullback scan turned away on each date."""
    failed = F.coalesce(strategies.first_failed(C("regime")), F.lit("passed"))
    counted = scan_input(spark, sf_dir).groupBy("d", failed.alias("gate")).agg(F.count("*").alias("tickers"))
    return counted.withColumn("pct", F.round(C("tickers") * 1e2 / F.sum("tickers").over(Window.partitionBy("d")), 2))


@query("SELECT d, round(count(*) FILTER (failed IS NULL OR failed NOT IN ('history', 'invalid', 'trend', 'rsi')) * 1e2 / count(*), 1) AS rsi_breadth_pct FROM gated GROUP BY d")
def scan_rsi_breadth(spark, sf_dir):
    """Share of tickers that get past the trend and RSI gates."""
    past = ~F.coalesce(strategies.first_failed(C("regime")).isin("history", "invalid", "trend", "rsi"), F.lit(False))
    return scan_input(spark, sf_dir).groupBy("d").agg(F.round(F.count(F.when(past, 1)) * 1e2 / F.count("*"), 1).alias("rsi_breadth_pct"))


# --- ranking and context ------------------------------------------------------------------------------

CTE["news"] = """SELECT u.ticker, doc_id, CASE n_chars % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label, n_chars % 97 / 97e0 AS strength
  FROM documents JOIN universe u ON doc_id % (SELECT count(*) FROM universe) = u.n"""
CTE["mood"] = """SELECT ticker, avg(CASE label WHEN 'positive' THEN strength WHEN 'negative' THEN -strength ELSE 0e0 END) AS sentiment, count(*) AS articles
  FROM (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY doc_id) <= 10) GROUP BY ticker"""
CTE["funda"] = """SELECT b.ticker, price, CASE WHEN n % 6 <> 0 THEN round(price * (0.9e0 + n % 5 * 0.1e0), 2) END AS target_mean_price, CASE n % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'hold' ELSE 'strong_buy' END AS recommendation,
  n % 9 AS num_analysts, CASE WHEN n % 7 <> 0 THEN n % 4 * 0.5e0 END AS debt_to_equity, CASE WHEN n % 8 <> 0 THEN 1 + n % 5 * 0.25e0 END AS current_ratio
  FROM (SELECT ticker, arg_max(close, d) AS price FROM bars GROUP BY ticker) b JOIN universe u ON b.ticker = u.ticker"""
CTE["surprises"] = """SELECT ticker, earnings_date, round(coalesce(surprise, CASE WHEN estimate = 0 THEN 0e0 ELSE (actual - estimate) / abs(estimate) * 100 END), 2) AS surprise_percent FROM earn"""
CTE["ctx0"] = """SELECT f.*, m.sentiment, s.surprise_percent, l.rsi_14, l.adx_14, l.volume_ratio, CASE WHEN l.t < 19 THEN 0e0 WHEN l.volume_ratio > 2 AND l.ret * 100 > 5 THEN 1.5e0 WHEN l.volume_ratio > 1.5e0 AND l.ret * 100 > 2 THEN 1e0 ELSE 0e0 END AS event
  FROM funda f JOIN (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1) l ON f.ticker = l.ticker LEFT JOIN mood m ON f.ticker = m.ticker
  LEFT JOIN (SELECT * FROM surprises QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY earnings_date DESC) = 1) s ON f.ticker = s.ticker"""
_HAS = "target_mean_price IS NOT NULL AND target_mean_price <> 0 AND price > 0"
CTE["ctx1"] = f"""SELECT *, CAST(CASE WHEN {_HAS} AND (target_mean_price - price) / price > 0.05e0 THEN 30 WHEN {_HAS} AND target_mean_price > price THEN 15 ELSE 0 END + CASE WHEN {_HAS} AND recommendation IN ('buy', 'strong_buy') THEN 10 ELSE 0 END AS DOUBLE) AS a,
  CASE WHEN surprise_percent > 5 THEN 30e0 WHEN surprise_percent > 0 THEN 15e0 WHEN surprise_percent < -5 THEN -15e0 ELSE 0e0 END AS e,
  CASE WHEN debt_to_equity < 1 THEN 10e0 ELSE 0e0 END + CASE WHEN current_ratio > 1.5e0 THEN 10e0 ELSE 0e0 END AS f,
  CASE WHEN sentiment > 0.2e0 THEN least(20e0, sentiment * 50) WHEN sentiment < -0.2e0 THEN -10e0 ELSE 0e0 END AS s, CASE WHEN event > 0 THEN least(15e0, event * 10) ELSE 0e0 END AS v FROM ctx0"""
CTE["ctx"] = """SELECT ticker, greatest(0e0, least(100e0, CASE WHEN a + e + f + s + v = 0 THEN least(15e0, greatest(0e0, (rsi_14 - 30) / 70) * 5 + greatest(0e0, (adx_14 - 10) / 40) * 5 + greatest(0e0, (volume_ratio - 0.5e0) * 10)) ELSE a + e + f + s + v END)) AS context_score,
  least(a, 40e0) AS analyst_pts, e AS earnings_pts, f AS fundamental_pts, s AS news_pts FROM ctx1"""


def context_scores(spark, sf_dir, weights: dict[str, float] = context.DEFAULTS) -> DataFrame:
    bars, universe = shared.written(market.bars(spark, sf_dir), "bars"), market.universe(spark, sf_dir)
    last = indicators.latest(indicators.all_indicators(bars).withColumn("event", indicators.price_volume_event())).select("ticker", "rsi_14", "adx_14", "volume_ratio", "event")
    reports = market.earnings(bars, universe)
    percent = context.surprise(C("actual"), C("estimate"), C("surprise"))
    surprises = reports.groupBy("ticker").agg(F.max_by(percent, "earnings_date").alias("surprise_percent"))
    rows = market.fundamentals(bars, universe).join(last, "ticker").join(context.sentiment(market.news(spark, sf_dir, universe)), "ticker", "left").join(surprises, "ticker", "left")
    return context.scored(rows, weights)


@query("SELECT ticker, round(context_score, 6) AS context_score FROM ctx")
def ctx_score(spark, sf_dir):
    return context_scores(spark, sf_dir).select("ticker", F.round("context_score", 6).alias("context_score"))


@query("SELECT ticker, analyst_pts, earnings_pts, fundamental_pts, round(news_pts, 6) AS news_pts FROM ctx")
def ctx_breakdown(spark, sf_dir):
    return context_scores(spark, sf_dir).select("ticker", "analyst_pts", "earnings_pts", "fundamental_pts", F.round("news_pts", 6).alias("news_pts"))


@query("SELECT ticker, earnings_date, surprise_percent FROM surprises")
def ctx_surprise(spark, sf_dir):
    reports = market.earnings(market.bars(spark, sf_dir), market.universe(spark, sf_dir))
    return reports.select("ticker", "earnings_date", context.surprise(C("actual"), C("estimate"), C("surprise")).alias("surprise_percent"))


@query("SELECT ticker, round(sentiment, 6) AS sentiment, articles FROM mood")
def ctx_sentiment(spark, sf_dir):
    return context.sentiment(market.news(spark, sf_dir, market.universe(spark, sf_dir))).withColumn("sentiment", F.round("sentiment", 6))


@query("""SELECT u.ticker, e.updated IS NOT NULL AND e.updated >= DATE '2001-09-01' AS hit FROM universe u LEFT JOIN (SELECT ticker, max(earnings_date) AS updated FROM earn WHERE earnings_date <= DATE '2001-10-01' GROUP BY ticker) e ON u.ticker = e.ticker""")
def ctx_cache_hits(spark, sf_dir):
    """Whether each ticker's cached context is within its lifetime (30 days before October 2001)."""
    universe = market.universe(spark, sf_dir)
    cached = market.earnings(market.bars(spark, sf_dir), universe).where("earnings_date <= date'2001-10-01'").groupBy("ticker").agg(F.max("earnings_date").alias("updated"))
    return universe.join(cached, "ticker", "left").select("ticker", F.coalesce(C("updated") >= F.lit("2001-09-01").cast("date"), F.lit(False)).alias("hit"))


def pool(spark, sf_dir) -> DataFrame:
    """All signals with what the ranker needs."""
    rows = shared.bucketed(scan_input(spark, sf_dir), "scan", "ticker")
    more = rows.select("ticker", "d", "industry", "dma_50", "macd_hist", "win_rate", "expectancy_pct", "total_signals")
    return strategies.scan_all(rows).join(more, ["ticker", "d"])


CTE["pool0"] = "SELECT a.*, s.industry, s.dma_50, s.macd_hist, s.win_rate, s.expectancy_pct, s.total_signals FROM all_signals a JOIN scanned s ON a.ticker = s.ticker AND a.d = s.d"
CTE["pool1"] = """SELECT *, (least(greatest(100 - 4 * abs(current_rsi - 50), 0e0), 100e0) + least(greatest(100 - 500 * abs(price / dma_50 - 1), 0e0), 100e0) + least(greatest(50 * volume_ratio, 0e0), 100e0) + least(greatest(50 + 200 * macd_hist, 0e0), 100e0)) / 4 AS raw_momentum FROM pool0"""
CTE["pool2"] = """SELECT *, (rank() OVER (PARTITION BY strategy, d ORDER BY raw_momentum) + (count(*) OVER (PARTITION BY strategy, d, raw_momentum) - 1) / 2e0) / count(*) OVER (PARTITION BY strategy, d) * 100 / (1 + exp(-(raw_momentum - 55) / 5)) AS momentum_score,
  (rank() OVER (PARTITION BY strategy, d ORDER BY win_rate) + (count(*) OVER (PARTITION BY strategy, d, win_rate) - 1) / 2e0) / count(*) OVER (PARTITION BY strategy, d) * 100 AS winrate_score,
  CASE WHEN coalesce(stddev_samp(expectancy_pct) OVER (PARTITION BY strategy, d), 0e0) < 1e-4 THEN 0e0 ELSE (expectancy_pct - avg(expectancy_pct) OVER (PARTITION BY strategy, d)) / stddev_samp(expectancy_pct) OVER (PARTITION BY strategy, d) END AS z FROM pool1"""
CTE["pool3"] = """SELECT *, CASE WHEN expectancy_pct < 0 THEN greatest(5e0, 100 / (1 + exp(-z)) - 30) ELSE 100 / (1 + exp(-z)) END AS expectancy_score,
  CASE WHEN CASE regime WHEN 'bull' THEN current_rsi BETWEEN 50 AND 70 AND price > dma_50 WHEN 'bear' THEN industry LIKE '%Utilities%' OR industry LIKE '%Health Care%' ELSE abs(current_rsi - 50) < 8 END THEN 100e0 ELSE 0e0 END AS regime_score FROM pool2"""
CTE["ranked"] = """SELECT *, round(0.3e0 * momentum_score + 0.4e0 * expectancy_score + 0.2e0 * winrate_score + 0.1e0 * regime_score, 4) AS preliminary,
  round(CASE regime WHEN 'bull' THEN 0.3e0 * momentum_score + 0.3e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score WHEN 'bear' THEN 0.15e0 * momentum_score + 0.35e0 * expectancy_score + 0.1e0 * winrate_score + 0.1e0 * regime_score
    ELSE 0.25e0 * momentum_score + 0.35e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score END, 4) AS rank_score FROM pool3"""
CTE["beta_ranked"] = """SELECT *, CASE WHEN CASE regime WHEN 'bull' THEN current_rsi BETWEEN 50 AND 70 AND price > dma_50 WHEN 'bear' THEN industry LIKE '%Utilities%' OR industry LIKE '%Health Care%' OR beta < 1
  ELSE abs(current_rsi - 50) < 8 END THEN 100e0 ELSE 0e0 END AS beta_score FROM (SELECT p.*, CASE WHEN n % 4 > 0 THEN round(0.7e0 + n % 5 * 0.15e0, 2) END AS beta FROM pool2 p JOIN universe u ON p.ticker = u.ticker)"""
KEYS = "strategy, ticker, d"


@query(f"SELECT {KEYS}, round(raw_momentum, 6) AS raw_momentum, round(momentum_score, 6) AS momentum_score FROM ranked")
def rank_momentum(spark, sf_dir):
    return ranking.scores(pool(spark, sf_dir)).select("strategy", "ticker", "d", F.round("raw_momentum", 6).alias("raw_momentum"), F.round("momentum_score", 6).alias("momentum_score"))


@query(f"SELECT {KEYS}, round(expectancy_score, 6) AS expectancy_score FROM ranked")
def rank_expectancy(spark, sf_dir):
    return ranking.scores(pool(spark, sf_dir)).select("strategy", "ticker", "d", F.round("expectancy_score", 6).alias("expectancy_score"))


@query(f"SELECT {KEYS}, round(winrate_score, 6) AS winrate_score, regime_score FROM ranked")
def rank_winrate(spark, sf_dir):
    return ranking.scores(pool(spark, sf_dir)).select("strategy", "ticker", "d", F.round("winrate_score", 6).alias("winrate_score"), "regime_score")


@query(f"SELECT {KEYS}, regime, preliminary, rank_score FROM ranked")
def rank_composite(spark, sf_dir):
    return ranking.scores(pool(spark, sf_dir)).select("strategy", "ticker", "d", "regime", "preliminary", "rank_score")


@query(f"SELECT {KEYS}, regime, beta, beta_score AS regime_score FROM beta_ranked")
def rank_beta(spark, sf_dir):
    """Regime scores with each stock's beta; a quarter of the stocks have none."""
    rows = pool(spark, sf_dir).join(market.betas(market.universe(spark, sf_dir)), "ticker", "left")
    return ranking.scores(rows).select("strategy", "ticker", "d", "regime", "beta", "regime_score")


CTE["tiers"] = """SELECT *, CASE WHEN rank_score >= CASE WHEN regime = 'bull' THEN 80 ELSE 75 END AND regime <> 'bear' AND expectancy_pct > 0 AND win_rate >= 35 AND total_signals >= 10 THEN 1
  WHEN rank_score >= 50 AND expectancy_pct >= 0 AND win_rate >= 25 AND total_signals >= 10 THEN 2 WHEN rank_score >= 40 AND expectancy_pct >= -2 THEN 3 ELSE 4 END AS tier FROM ranked"""


@query(f"""SELECT {KEYS}, tier, row_number() OVER (PARTITION BY strategy, d ORDER BY CASE WHEN firsts >= 3 THEN tier ELSE 0 END, rank_score DESC, ticker) AS place
  FROM (SELECT *, count(*) FILTER (tier = 1) OVER (PARTITION BY strategy, d) AS firsts FROM tiers WHERE tier <= 2)""")
def rank_tiers(spark, sf_dir):
    return ranking.tiered(ranking.scores(pool(spark, sf_dir))).select("strategy", "ticker", "d", "tier", "place")


@query("SELECT d, tier, count(*) AS signals FROM tiers GROUP BY d, tier")
def rank_tier_counts(spark, sf_dir):
    return ranking.scores(pool(spark, sf_dir)).groupBy("d", ranking.tier().alias("tier")).agg(F.count("*").alias("signals"))


@query(f"SELECT {KEYS}, preliminary, row_number() OVER (PARTITION BY strategy, d ORDER BY preliminary DESC, ticker) AS place FROM ranked QUALIFY row_number() OVER (PARTITION BY strategy, d ORDER BY preliminary DESC, ticker) <= 50")
def rank_topk(spark, sf_dir):
    """The fifty best of each pool before context."""
    return ranking.top(ranking.scores(pool(spark, sf_dir)), 50, "preliminary", "strategy", "d").select("strategy", "ticker", "d", "preliminary", "place")


CTE["placed"] = "SELECT *, CASE strategy " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(strategies.ORDER)) + " END AS reg FROM all_signals"
CTE["deduped"] = "SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY d, ticker ORDER BY quality_score DESC, reg) = 1"


# what each scan's ranker hands on: written from the rules of the scans, blocked signals out
CTE["handed"] = """SELECT * FROM all_signals WHERE guard_reason IS NULL QUALIFY row_number() OVER (PARTITION BY strategy, d ORDER BY CASE strategy WHEN 'csm' THEN coalesce(returns_3m, 0e0) ELSE composite_score END DESC,
  CASE strategy WHEN 'csm' THEN -composite_score WHEN 'pead' THEN CAST(coalesce(days_since, 5) AS DOUBLE) ELSE 0e0 END, ticker)
  <= CASE strategy WHEN 'trend' THEN 5 WHEN 'mean_reversion' THEN 5 WHEN 'csm' THEN 5 WHEN 'sector' THEN 3 WHEN 'pead' THEN 3 WHEN 'high_52w' THEN 3 ELSE 50 END"""
CTE["chosen"] = "SELECT * FROM (SELECT *, CASE strategy " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(strategies.ORDER)) + " END AS reg FROM handed) QUALIFY row_number() OVER (PARTITION BY d, ticker ORDER BY quality_score DESC, reg) = 1"


def handed(spark, sf_dir) -> DataFrame:
    return ranking.by_strategy(scan_union(spark, sf_dir))


@query("SELECT strategy, d, ticker, composite_score, returns_3m, days_since FROM handed")
def rank_by_strategy(spark, sf_dir):
    """What each scan hands on: unblocked, in its own order, capped."""
    return handed(spark, sf_dir).select("strategy", "d", "ticker", "composite_score", "returns_3m", "days_since")


@query("SELECT strategy, d, count(*) AS signals, count(*) FILTER (guard_reason IS NOT NULL) AS blocked FROM all_signals GROUP BY strategy, d")
def rank_blocked(spark, sf_dir):
    """Signals and blocked ones of each scan and date."""
    return scan_union(spark, sf_dir).groupBy("strategy", "d").agg(F.count("*").alias("signals"), F.count("guard_reason").alias("blocked"))


@query("SELECT d, ticker, strategy, quality_score FROM chosen")
def rank_dedupe(spark, sf_dir):
    return ranking.best_of_ticker(handed(spark, sf_dir)).select("d", "ticker", "strategy", "quality_score")


@query("""SELECT d, ticker, strategy, composite_score, place FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY composite_score DESC, ticker) AS place
  FROM (SELECT *, max(composite_score) OVER (PARTITION BY d) AS best FROM chosen) WHERE best < 80 OR composite_score >= 80) WHERE place <= 3""")
def rank_quality_gate(spark, sf_dir):
    best = ranking.best_of_ticker(handed(spark, sf_dir))
    return ranking.quality_gate(best).select("d", "ticker", "strategy", "composite_score", "place")


@query("SELECT strategy, d, count(*) AS handed_on, min(composite_score) AS least FROM handed GROUP BY strategy, d")
def rank_strategy_caps(spark, sf_dir):
    """How many signals each scan hands on under its cap, and the lowest score among them."""
    return handed(spark, sf_dir).groupBy("strategy", "d").agg(F.count("*").alias("handed_on"), F.min("composite_score").alias("least"))
