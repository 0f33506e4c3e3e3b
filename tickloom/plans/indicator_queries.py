"""Queries over bars, indicators, backtests and studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import backtest, indicators
from tickloom.plans import oracle
from tickloom.sources import market

C = F.col
QUERIES: dict = {}
AT = ("ticker", "d")


def query(sql: str | None):
    """Register a query, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            oracle.SQL[f.__name__] = oracle.query(sql)
        return f

    return add


def ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.all_indicators(market.bars(spark, sf_dir))


def _register(name: str, *columns: str, nudge: float = 0.0) -> None:
    """Rounded columns; ``nudge`` moves values that would lie on a tie, which engines round either way."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ind(spark, sf_dir).select(*AT, *(F.round(C(c) + nudge, 6).alias(c) for c in columns))

    run.__name__ = name
    query(f"SELECT ticker, d, {', '.join(f'round({c} + {nudge!r}, 6) AS {c}' for c in columns)} FROM ind")(run)


for _name, _cols in {
    "ind_volume_ma": ("volume_ma_20", "volume_ratio"),
    "ind_ema20": ("ema_20",), "ind_rsi14": ("rsi_14", "rsi_min_10", "rsi_min_5"), "ind_macd": ("macd", "macd_signal", "macd_hist"),
    "ind_atr14": ("tr", "atr_14"), "ind_atr_proxy": ("atr_proxy",), "ind_atr_wilder": ("atr_wilder",), "ind_adx14": ("di_plus", "di_minus", "adx_14"),
    "ind_bollinger": ("bb_low", "bb_up", "bb_position"), "ind_rolling_extremes": ("high_20", "high_252", "low_10", "low_20", "from_high_20"),
    "ind_return_63": ("return_63",), "ind_swing_low": ("swing_low",), "ind_worst_return": ("worst_5",),
}.items():
    _register(_name, *_cols)
# means of prices with four places often end in a 5 at the seventh
_register("ind_sma", "dma_50", "dma_200", nudge=1e-8)
_register("ind_sma_full", "sma_20", "sma_50", "sma_200", nudge=1e-8)


@query("SELECT ticker, d, open, high, low, close, volume, t FROM bars")
def bars_weekly(spark, sf_dir):
    return market.bars(spark, sf_dir)


@query("SELECT ticker, d, close FROM bars WHERE d BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def bars_range_scan(spark, sf_dir):
    return market.bars(spark, sf_dir).where(C("d").between("1997-01-01", "1998-12-31")).select("ticker", "d", "close")


@query("SELECT ticker, d, close FROM bars WHERE ticker = (SELECT min(ticker) FROM universe) AND d >= DATE '1997-01-01' AND d < DATE '1998-01-01'")
def bars_ticker_lookup(spark, sf_dir):
    first = market.universe(spark, sf_dir).where("n = 0").select("ticker")
    found = market.bars(spark, sf_dir).join(F.broadcast(first), "ticker", "left_semi")
    return found.where((C("d") >= "1997-01-01") & (C("d") < "1998-01-01")).select("ticker", "d", "close")


@query("""SELECT ticker, max(d) AS last_date, count(*) AS n_bars, max(d) < DATE '2001-11-01' AS stale FROM bars GROUP BY ticker""")
def bars_last_date(spark, sf_dir):
    return market.bars(spark, sf_dir).groupBy("ticker").agg(F.max("d").alias("last_date"), F.count("*").alias("n_bars"), (F.max("d") < F.lit("2001-11-01").cast("date")).alias("stale"))


@query("SELECT ticker, d, coalesce(best_5 >= 0.02e0, false) AS has_gap, round(best_5, 6) AS best_5 FROM ind")
def ind_gap(spark, sf_dir):
    return ind(spark, sf_dir).select(*AT, F.coalesce(C("best_5") >= 0.02, F.lit(False)).alias("has_gap"), F.round("best_5", 6).alias("best_5"))


@query("SELECT ticker, d, coalesce(rsi_min_10 < 45 AND rsi_14 BETWEEN 45 AND 62, false) AS recovered FROM ind")
def ind_rsi_recovery(spark, sf_dir):
    return ind(spark, sf_dir).select(*AT, indicators.recovery().alias("recovered"))


_PARTS = """SELECT *, 1 - abs(coalesce(rsi_14, 55) - 55) / 35 AS rsi_part, least(1e0, (coalesce(adx_14, 20) - 10) / 25) AS adx_part,
  least(1e0, (volume_ratio - 0.5e0) / 1.5e0) AS volume_part, CASE WHEN dma_50 > 0 THEN least(1e0, (close / dma_50 - 0.95e0) / 0.15e0) ELSE 1e0 END AS dma_part FROM ind"""
oracle.CTE["parts"] = _PARTS
oracle.CTE["cons"] = """SELECT *, (rsi_part + adx_part + volume_part + dma_part) / 4 > 0.65e0 AND CAST(rsi_part > 0.5e0 AS INTEGER) + CAST(adx_part > 0.5e0 AS INTEGER)
  + CAST(volume_part > 0.5e0 AS INTEGER) + CAST(dma_part > 0.5e0 AS INTEGER) >= 3 AS consensus FROM parts"""


@query("SELECT ticker, d, round(rsi_part, 6) AS rsi_part, round(adx_part, 6) AS adx_part, round(volume_part, 6) AS volume_part, round(dma_part, 6) AS dma_part, consensus FROM cons")
def ind_consensus(spark, sf_dir):
    parts = {n: F.round(c, 6) for n, c in indicators.consensus_parts().items()}
    return ind(spark, sf_dir).select(*AT, *(c.alias(n) for n, c in parts.items()), indicators.consensus().alias("consensus"))


@query("""SELECT ticker, d, CASE WHEN t < 19 THEN 0e0 WHEN volume_ratio > 2 AND ret * 100 > 5 THEN 1.5e0 WHEN volume_ratio > 1.5e0 AND ret * 100 > 2 THEN 1e0 ELSE 0e0 END AS event FROM ind""")
def ind_pv_event(spark, sf_dir):
    return ind(spark, sf_dir).select(*AT, indicators.price_volume_event().alias("event"))


@query(f"""SELECT d, round(return_20, 6) AS return_20, round(vol_20, 6) AS vol_20, round(vix_norm, 6) AS vix_norm, round(breadth_20, 6) AS breadth_20 FROM (
  SELECT d, ln(close / lag(close, 20) {oracle.T}) AS return_20, CASE WHEN t2 >= 20 THEN stddev_samp(lr) {oracle.w(20)} * sqrt(252e0) END AS vol_20, vix / 100 AS vix_norm,
    CASE WHEN t2 >= 19 THEN avg(CASE WHEN lr > 0 THEN 1e0 ELSE 0e0 END) {oracle.w(20)} END AS breadth_20
  FROM (SELECT *, row_number() {oracle.T} - 1 AS t2, ln(close / lag(close) {oracle.T}) AS lr FROM (SELECT i.*, v.vix FROM idx i JOIN vix v ON i.d = v.d WHERE v.vix IS NOT NULL)))
  WHERE return_20 IS NOT NULL AND vol_20 IS NOT NULL""")
def ind_hmm_features(spark, sf_dir):
    index = market.index_bars(market.bars(spark, sf_dir))
    found = indicators.hmm_features(index, market.volatility_index(index))
    return found.select("d", *(F.round(c, 6).alias(c) for c in ("return_20", "vol_20", "vix_norm", "breadth_20")))


@query("""SELECT ticker, d, close, round(dma_50, 9) AS dma_50, round(dma_200, 9) AS dma_200, round(rsi_14, 6) AS rsi_14, round(volume_ma_20, 6) AS volume_ma_20, volume, round(adx_14, 6) AS adx_14
  FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1""")
def ind_latest_snapshot(spark, sf_dir):
    last = indicators.latest(ind(spark, sf_dir))
    return last.select(*AT, "close", *(F.round(c, 9).alias(c) for c in ("dma_50", "dma_200")), *(F.round(c, 6).alias(c) for c in ("rsi_14", "volume_ma_20", "adx_14")), "volume")


@query("""SELECT * FROM (WITH RECURSIVE tops AS (SELECT DISTINCT ticker, round(high, 2) AS high FROM (
    SELECT *, max(high) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, max(t) OVER (PARTITION BY ticker) - t AS age FROM bars) WHERE high = top AND age < 120),
  kept(ticker, high) AS (SELECT ticker, min(high) FROM tops GROUP BY ticker UNION ALL
    SELECT k.ticker, min(s.high) FROM kept k JOIN tops s ON s.ticker = k.ticker AND s.high > k.high * (1 + 0.02e0) GROUP BY k.ticker, k.high)
  SELECT ticker, high FROM kept)""")
def ind_significant_highs(spark, sf_dir):
    return indicators.significant_highs(market.bars(spark, sf_dir)).select("ticker", F.explode("highs").alias("high"))


oracle.CTE["candle"] = f"""SELECT ticker, d, t, pattern, round(CASE WHEN pattern = 'engulfing' THEN close ELSE high * 1.001e0 END + 1e-9, 2) AS entry FROM (
  SELECT *, CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 'engulfing'
    WHEN abs(close - open) > 0 AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.5e0 * abs(close - open) THEN 'hammer'
    WHEN high < ph AND low > pl THEN 'inside' END AS pattern
  FROM (SELECT *, lag(open) {oracle.T} AS po, lag(close) {oracle.T} AS pc, lag(high) {oracle.T} AS ph, lag(low) {oracle.T} AS pl FROM bars)) WHERE pattern IS NOT NULL"""


@query("SELECT ticker, d, t, pattern, entry FROM candle")
def pattern_candles(spark, sf_dir):
    return indicators.candles(market.bars(spark, sf_dir))


@query(f"""SELECT ticker, d, round(resistance, 4) AS resistance, round((resistance / close - 1) * 100, 4) AS upside_pct, round((resistance - close) / nullif(close - swing_low, 0), 4) AS risk_reward
  FROM (SELECT *, max(high) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) AS resistance FROM ind) WHERE swing_low IS NOT NULL AND resistance > close""")
def pattern_levels(spark, sf_dir):
    """Resistance over the last 126 bars, upside and risk-reward from the swing low."""
    top = F.max("high").over(Window.partitionBy("ticker").orderBy("d").rowsBetween(-126, -1))
    levels = ind(spark, sf_dir).withColumn("resistance", top).where("swing_low is not null and resistance > close")
    return levels.select(*AT, *rounded(resistance=("resistance", 4), upside_pct=((C("resistance") / C("close") - 1) * 100, 4), risk_reward=(F.try_divide(C("resistance") - C("close"), C("close") - C("swing_low")), 4)))


@query("SELECT ticker, d, t, entry, stop, target FROM sig")
def bt_signals(spark, sf_dir):
    return backtest.signals(ind(spark, sf_dir))


def _trades(spark, sf_dir, idealised: bool = False, **options) -> DataFrame:
    bars = market.bars(spark, sf_dir)
    return backtest.simulate(backtest.signals(indicators.all_indicators(bars), **options), bars, idealised)


@query("SELECT ticker, d, t, entry, stop, target, entry_t, fill, outcome, holding, exit, round(return_pct, 6) AS return_pct FROM trades")
def bt_trades(spark, sf_dir):
    return _trades(spark, sf_dir).withColumn("return_pct", F.round("return_pct", 6))


oracle.CTE["ideal"] = oracle.trades("sig", idealised=True)


@query("SELECT ticker, d, t, outcome, holding, round(return_pct, 6) AS return_pct FROM ideal")
def bt_trades_idealised(spark, sf_dir):
    return _trades(spark, sf_dir, True).select("ticker", "d", "t", "outcome", "holding", F.round("return_pct", 6).alias("return_pct"))


@query("SELECT * FROM metrics")
def bt_metrics(spark, sf_dir):
    return backtest.ticker_metrics(_trades(spark, sf_dir), market.universe(spark, sf_dir))


@query(f"SELECT year(d) AS year, {oracle.METRICS} FROM trades GROUP BY 1")
def bt_by_year(spark, sf_dir):
    return backtest.metrics(_trades(spark, sf_dir).withColumn("year", F.year("d").cast("long")), "year")


@query(f"SELECT CASE WHEN d < DATE '2000-01-01' THEN 'train' ELSE 'validation' END AS period, {oracle.METRICS} FROM trades GROUP BY 1")
def bt_train_valid(spark, sf_dir):
    split = F.when(C("d") < F.lit("2000-01-01").cast("date"), "train").otherwise("validation")
    return backtest.metrics(_trades(spark, sf_dir).withColumn("period", split), "period")


@query("""SELECT wins, n, round((p + 3.8416e0 / (2 * n) - h) / (1 + 3.8416e0 / n) * 100, 4) AS low, round((p + 3.8416e0 / (2 * n) + h) / (1 + 3.8416e0 / n) * 100, 4) AS high
  FROM (SELECT *, 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4e0 * n * n)) AS h FROM (SELECT wins, n, wins * 1e0 / nullif(n, 0) AS p FROM (
  SELECT count(*) FILTER (outcome = 'win') AS wins, count(outcome) AS n FROM trades)))""")
def bt_wilson(spark, sf_dir):
    counted = _trades(spark, sf_dir).agg(F.count(F.when(C("outcome") == "win", 1)).alias("wins"), F.count("outcome").alias("n"))
    low, high = backtest.wilson(C("wins"), C("n"))
    return counted.select("wins", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


_FAILS = {"trend": "NOT (close > dma_50 AND dma_50 > dma_200)", "dip": "NOT coalesce(rsi_min_10 < 45, false)", "band": "NOT coalesce(rsi_14 BETWEEN 45 AND 65, false)",
          "volume": "NOT (volume > volume_ma_20)", "swing_low": "swing_low IS NULL"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER ({c}) AS failures, round(count(*) FILTER ({c}) * 1e2 / nullif(count(*), 0), 2) AS failure_pct FROM ind WHERE t >= 200" for n, c in _FAILS.items()))
def bt_diagnostics(spark, sf_dir):
    return backtest.diagnostics(ind(spark, sf_dir))


@query("""SELECT side, ticker, expectancy_pct, total_signals FROM (SELECT *, row_number() OVER (ORDER BY expectancy_pct DESC, ticker) AS a, row_number() OVER (ORDER BY expectancy_pct, ticker) AS b FROM metrics)
  CROSS JOIN (VALUES ('top'), ('bottom')) s(side) WHERE (side = 'top' AND a <= 10) OR (side = 'bottom' AND b <= 10)""")
def bt_top_bottom(spark, sf_dir):
    """The ten best and worst tickers by expectancy: two top-k plans."""
    found = bt_metrics(spark, sf_dir).select("ticker", "expectancy_pct", "total_signals")
    top = found.orderBy(F.desc("expectancy_pct"), "ticker").limit(10).withColumn("side", F.lit("top"))
    return top.union(found.orderBy("expectancy_pct", "ticker").limit(10).withColumn("side", F.lit("bottom")))


@query("""SELECT bucket, count(*) AS tickers FROM (SELECT CASE WHEN total_signals = 0 THEN '0' WHEN total_signals <= 5 THEN '1-5' WHEN total_signals <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM metrics) GROUP BY bucket""")
def bt_signal_histogram(spark, sf_dir):
    n = C("total_signals")
    return bt_metrics(spark, sf_dir).groupBy(F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").otherwise("11+").alias("bucket")).agg(F.count("*").alias("tickers"))


#: Name, volume multiple and the filters that stay.
ABLATIONS = (
    ("all", 1.0, ("trend", "dip", "band", "volume")), ("no_volume", 1.0, ("trend", "dip", "band")), ("no_band", 1.0, ("trend", "dip", "volume")),
    ("no_dip", 1.0, ("trend", "band", "volume")), ("trend_only", 1.0, ("trend",)),
)
VOLUMES = (("1.5", 1.5, ABLATIONS[0][2]), ("1.2", 1.2, ABLATIONS[0][2]), ("1.0", 1.0, ABLATIONS[0][2]))
#: The same with a candle pattern as one more filter, and without each.
CANDLE_ABLATIONS = (*((n, v, (*use, "candle")) for n, v, use in ABLATIONS[:-1]), ("no_candle", *ABLATIONS[0][1:]), ABLATIONS[-1])
_GATE = {"candle": "EXISTS (SELECT 1 FROM candle WHERE candle.ticker = loose_trades.ticker AND candle.t = loose_trades.t)", "trend": "close > dma_50 AND dma_50 > dma_200", "dip": "rsi_min_10 < 45", "band": "rsi_14 BETWEEN 45 AND 65", "volume": "volume > {v!r} * volume_ma_20"}


def _study(spark, sf_dir, variants) -> DataFrame:
    """Metrics of every variant from one simulation of the loosest signals.

    A signal's trade does not depend on the filters, so each variant is a mask.
    """
    bars = market.bars(spark, sf_dir)
    found = indicators.all_indicators(bars)
    trades = backtest.simulate(backtest.signals(found, use=()), bars)
    flags = found.select("ticker", "t", "close", "dma_50", "dma_200", "rsi_min_10", "rsi_14", "volume", "volume_ma_20")
    if any("candle" in use for _, _, use in variants):
        flags = flags.join(indicators.candles(bars).select("ticker", "t", F.lit(True).alias("candle")), ["ticker", "t"], "left")
    gates = {"candle": C("candle"), "trend": (C("close") > C("dma_50")) & (C("dma_50") > C("dma_200")), "dip": C("rsi_min_10") < 45, "band": C("rsi_14").between(45, 65)}

    def mask(v: float, use) -> F.Column:
        return reduce(lambda a, b: a & b, [gates.get(u, C("volume") > v * C("volume_ma_20")) for u in use])

    names = F.array_compact(F.array(*(F.when(mask(v, use), F.lit(n)) for n, v, use in variants)))
    tagged = trades.join(flags, ["ticker", "t"]).select("outcome", "holding", "return_pct", F.explode(names).alias("experiment"))
    return backtest.metrics(tagged, "experiment")


def _study_sql(variants) -> str:
    oracle.CTE["loose"] = """SELECT *, round(entry + 3 * (entry - stop), 2) AS target FROM (
      SELECT ticker, d, t, round(high * 1.001e0, 2) AS entry, swing_low AS stop, close, dma_50, dma_200, rsi_min_10, rsi_14, volume, volume_ma_20
      FROM (SELECT *, max(t) OVER (PARTITION BY ticker) AS last FROM ind) WHERE t >= 200 AND t <= last - 1 AND swing_low IS NOT NULL) WHERE stop < entry"""
    oracle.CTE["loose_trades"] = oracle.trades("loose")
    one = lambda n, v, use: f"SELECT '{n}' AS experiment, {oracle.METRICS} FROM loose_trades WHERE {' AND '.join(_GATE[u].format(v=v) for u in use)} HAVING count(*) > 0"
    return " UNION ALL ".join(one(*x) for x in variants)


@query(_study_sql(ABLATIONS))
def study_ablation(spark, sf_dir):
    return _study(spark, sf_dir, ABLATIONS)


@query(_study_sql(CANDLE_ABLATIONS))
def study_ablation_candles(spark, sf_dir):
    return _study(spark, sf_dir, CANDLE_ABLATIONS)


@query(_study_sql(VOLUMES))
def study_volume(spark, sf_dir):
    return _study(spark, sf_dir, VOLUMES)


GRID = {"rsi_dip": (35, 40, 45, 50, 55), "rsi_recovery_max": (58, 62, 66, 70), "adx_min": (10, 14, 18, 22, 26), "volume_min": (0.6, 0.8, 1.0, 1.2), "trades_floor": (0, 1, 3)}


def _grid(spark: SparkSession) -> DataFrame:
    """All combinations of the studied parameters (1200 rows, whatever the data)."""
    one = spark.range(1)
    for name, values in GRID.items():
        one = one.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return one.drop("id")


def _sensitivity(spark, sf_dir) -> DataFrame:
    last = indicators.latest(ind(spark, sf_dir)).where("close > dma_50 and dma_50 > dma_200").select("ticker", "rsi_min_10", "rsi_14", "adx_14", "volume_ratio")
    pool = last.join(bt_metrics(spark, sf_dir).select("ticker", "total_signals"), "ticker")
    meets = (C("rsi_min_10") < C("rsi_dip")) & C("rsi_14").between(30, C("rsi_recovery_max")) & (C("adx_14") >= C("adx_min")) & (C("volume_ratio") >= C("volume_min")) & (C("total_signals") >= C("trades_floor"))
    grid = F.broadcast(_grid(spark))
    keys = list(GRID)
    # the grid is a fixed set of parameters, held against every candidate
    hits = pool.join(grid, meets).groupBy(*keys).agg(F.count("*").alias("tickers_passed"), F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"))
    return grid.join(hits, keys, "left").select(*keys, F.coalesce("tickers_passed", F.lit(0)).alias("tickers_passed"), F.coalesce("tickers", F.lit("")).alias("tickers"))


oracle.CTE["grid"] = "SELECT * FROM " + ", ".join(f"(VALUES {', '.join(f'({v!r}{'e0' if isinstance(v, float) else ''})' for v in vs)}) {n}_t({n})" for n, vs in GRID.items())
oracle.CTE["pool"] = """SELECT l.*, m.total_signals FROM (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1) l JOIN metrics m ON l.ticker = m.ticker
  WHERE close > dma_50 AND dma_50 > dma_200"""
oracle.CTE["cells"] = """SELECT g.rsi_dip, g.rsi_recovery_max, g.adx_min, g.volume_min, g.trades_floor, count(p.ticker) AS tickers_passed, coalesce(string_agg(p.ticker, ',' ORDER BY p.ticker), '') AS tickers
  FROM grid g LEFT JOIN pool p ON p.rsi_min_10 < g.rsi_dip AND p.rsi_14 BETWEEN 30 AND g.rsi_recovery_max AND p.adx_14 >= g.adx_min AND p.volume_ratio >= g.volume_min AND p.total_signals >= g.trades_floor
  GROUP BY ALL"""


@query("SELECT * FROM cells")
def study_sensitivity(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


@query("""SELECT max(tickers_passed) AS most, min(tickers_passed) AS least, count(*) FILTER (tickers_passed BETWEEN 8 AND 20) AS balanced, count(*) AS cells FROM cells""")
def study_sensitivity_summary(spark, sf_dir):
    return _sensitivity(spark, sf_dir).agg(F.max("tickers_passed").alias("most"), F.min("tickers_passed").alias("least"), F.count(F.when(C("tickers_passed").between(8, 20), 1)).alias("balanced"), F.count("*").alias("cells"))


@query("SELECT * FROM cells ORDER BY tickers_passed DESC, trades_floor DESC, adx_min DESC, volume_min DESC, rsi_dip, rsi_recovery_max LIMIT 1")
def study_sensitivity_best(spark, sf_dir):
    """The cell that passes most, the strictest of these."""
    return _sensitivity(spark, sf_dir).orderBy(F.desc("tickers_passed"), F.desc("trades_floor"), F.desc("adx_min"), F.desc("volume_min"), "rsi_dip", "rsi_recovery_max").limit(1)
