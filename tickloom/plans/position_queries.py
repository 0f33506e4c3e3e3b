"""Queries over sizing, positions, ledgers, views and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import in_order
from tickloom.operators import calendar, indicators, joins, positions, ranking, sizing
from tickloom.plans import oracle
from tickloom.plans.indicator_queries import C, query
from tickloom.plans.signal_queries import bars_with_indicators, percent_up, scan_union, signals, wide_metrics
from tickloom.sources import market, shared, tables

CTE = oracle.CTE
VALUE, CASH = 10000.0, 900.0
LABELS = ("50/30/20", "K: 5.0%", "K: 3.2% (0.88 sh)", "Kelly: 11.2%", "")

CTE["held"] = f"""SELECT *, CASE WHEN day(d) % 3 <> 0 THEN max_shares0 END AS max_shares, CASE WHEN day(d) % 3 <> 0 THEN dollars END AS allocated_dollars FROM (
  SELECT *, round(dollars / entry_price, 4) AS max_shares0 FROM (
  SELECT strategy || ':' || ticker || ':' || d AS id, strategy, ticker, d, entry_price, stop_loss, target_1, target_2, target_3, composite_score, weighted_rr, narrative,
    CASE day(d) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'closed' ELSE 'open' END AS status, CASE WHEN day(d) % 7 = 0 THEN 'Target 1 hit – sell 50%' END AS sell_signal_reason,
    ([{', '.join(repr(x) for x in LABELS)}])[day(d) % 5 + 1] AS position_sizing, round(200 + composite_score * 5, 2) AS dollars FROM deduped))"""


def held(spark, sf_dir, found: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Positions made of the best signal of each ticker and date, in all states; of bars with indicators, and metrics, where a plan has them already."""
    best, day = ranking.best_of_ticker(signals(spark, sf_dir, found, metrics=metrics)), F.dayofmonth("d")
    dollars = F.round(200 + C("composite_score") * 5, 2)
    rows = best.select(
        F.concat_ws(":", "strategy", "ticker", C("d").cast("string")).alias("id"), "strategy", "ticker", "d", "entry_price", "stop_loss", "target_1", "target_2", "target_3", "composite_score", "weighted_rr", "narrative",
        F.when(day % 4 == 0, "pending").when(day % 4 == 1, "closed").otherwise("open").alias("status"),
        F.when(day % 7 == 0, positions.REASONS["hit_t1"]).alias("sell_signal_reason"),
        F.element_at(F.array(*(F.lit(x) for x in LABELS)), day % 5 + 1).alias("position_sizing"),
        F.when(day % 3 != 0, F.round(dollars / C("entry_price"), 4)).alias("max_shares"), F.when(day % 3 != 0, dollars).alias("allocated_dollars"),
    )
    return rows


CTE["kelly"] = """SELECT *, greatest(0e0, (p - (1 - p) / rr) / 2) AS fraction FROM (SELECT *, CASE WHEN composite_score >= 90 THEN 0.75e0 WHEN composite_score >= 80 THEN 0.68e0 WHEN composite_score >= 70 THEN 0.6e0 WHEN composite_score >= 60 THEN 0.52e0
  WHEN composite_score >= 50 THEN 0.45e0 ELSE 0.35e0 END AS p, CASE WHEN weighted_rr > 0 THEN weighted_rr ELSE 2e0 END AS rr FROM deduped)"""


@query("SELECT d, ticker, round(fraction, 6) AS fraction FROM kelly")
def size_kelly(spark, sf_dir):
    best = ranking.best_of_ticker(scan_union(spark, sf_dir))
    return best.select("d", "ticker", F.round(sizing.half_kelly(C("composite_score"), C("weighted_rr")), 6).alias("fraction"))


SHARES = "CASE WHEN entry_price > 0 THEN round(allocated_dollars / entry_price, 4) ELSE 0e0 END"
SIZED = f"""'K: ' || printf('%.1f', round(allocated_dollars / {VALUE} * 100 + 1e-9, 1)) || '%' || CASE WHEN {SHARES} > 0 THEN ' (' || CASE WHEN {SHARES} < 1 THEN printf('%.2f', round({SHARES} + 1e-9, 2)) ELSE CAST(CAST(floor({SHARES}) AS BIGINT) AS VARCHAR) END || ' sh)' ELSE '' END"""


@query(f"""SELECT d, ticker, allocated_dollars, CASE WHEN entry_price > 0 THEN round(allocated_dollars / entry_price, 4) ELSE 0e0 END AS max_shares, {SIZED} AS position_sizing
  FROM (SELECT *, round(wanted * CASE WHEN sum(wanted) OVER (PARTITION BY d) > {CASH} THEN {CASH} / sum(wanted) OVER (PARTITION BY d) ELSE 1e0 END, 2) AS allocated_dollars
  FROM (SELECT *, least({VALUE} * fraction, {VALUE * sizing.CAP}) AS wanted FROM kelly))""")
def size_normalized(spark, sf_dir):
    best = ranking.best_of_ticker(scan_union(spark, sf_dir))
    rows = best.withColumns({"fraction": sizing.half_kelly(C("composite_score"), C("weighted_rr")), "portfolio_value": F.lit(VALUE), "cash": F.lit(CASH)})
    return sizing.normalised(rows, "d").select("d", "ticker", "allocated_dollars", "max_shares", "position_sizing")


@query(f"""SELECT d, ticker, size_mult, round(wanted * CASE WHEN sum(wanted) OVER (PARTITION BY d) > {CASH} THEN {CASH} / sum(wanted) OVER (PARTITION BY d) ELSE 1e0 END, 2) AS allocated_dollars
  FROM (SELECT *, least({VALUE} * fraction * size_mult, {VALUE * sizing.CAP}) AS wanted FROM kelly)""")
def size_override(spark, sf_dir):
    """Dollars of each date's signals, halved where the volatility index has overridden the regime."""
    best = ranking.best_of_ticker(scan_union(spark, sf_dir))
    rows = best.withColumns({"fraction": sizing.half_kelly(C("composite_score"), C("weighted_rr")) * C("size_mult"), "portfolio_value": F.lit(VALUE), "cash": F.lit(CASH)})
    return sizing.normalised(rows, "d").select("d", "ticker", "size_mult", "allocated_dollars")


_BAD = "target_1 <= entry_price"


def _anew(k: int, m: float, p: int) -> str:
    return f"CASE WHEN {_BAD} THEN CASE WHEN atr > 0 THEN round(entry_price + {m}e0 * atr, 2) ELSE {percent_up('entry_price', p)} END ELSE target_{k} END AS target_{k}"


@query(f"""SELECT id, greatest(stop_loss, round(entry_price * 0.93e0, 2)) AS stop_loss, {_anew(1, 1.5, 7)}, {_anew(2, 2.5, 12)}, {_anew(3, 3.5, 18)}
  FROM (SELECT h.id, h.entry_price, h.stop_loss, CASE WHEN day(h.d) % 2 = 0 THEN h.entry_price ELSE h.target_1 END AS target_1, h.target_2, h.target_3, CASE WHEN day(h.d) % 4 = 0 THEN i.atr_proxy ELSE 0e0 END AS atr FROM held h JOIN ind i ON h.ticker = i.ticker AND h.d = i.d)""")
def size_stop_ceiling(spark, sf_dir):
    found = bars_with_indicators(spark, sf_dir)
    day = F.dayofmonth("d")
    rows = held(spark, sf_dir, found).join(found.select("ticker", "d", "atr_proxy"), ["ticker", "d"])
    rows = rows.withColumns({"target_1": F.when(day % 2 == 0, C("entry_price")).otherwise(C("target_1")), "atr": F.when(day % 4 == 0, C("atr_proxy")).otherwise(0.0)})
    return sizing.ceiling(rows).select("id", "stop_loss", "target_1", "target_2", "target_3")


_PCT = r"""CASE WHEN {c} LIKE '%/%' THEN 5e0 ELSE coalesce(least(TRY_CAST(trim(regexp_replace(regexp_replace({c}, 'Kelly:|K:|%', '', 'g'), '\(.*\)', '', 'g')) AS DOUBLE), 5e0), 5e0) END"""


@query(rf"SELECT id, position_sizing, {_PCT.format(c='position_sizing')} AS pct, TRY_CAST(nullif(regexp_extract(position_sizing, '\(([\d.]+)\s*sh\)', 1), '') AS DOUBLE) AS shares FROM held")
def size_parse_alloc(spark, sf_dir):
    return held(spark, sf_dir).select("id", "position_sizing", sizing.parsed_percent(C("position_sizing")).alias("pct"), sizing.parsed_shares(C("position_sizing")).alias("shares"))


@query(f"SELECT round(coalesce(sum(CASE WHEN allocated_dollars > 0 THEN allocated_dollars ELSE {_PCT.format(c='position_sizing')} / 100 * {VALUE} END), 0e0), 4) AS allocated FROM held WHERE status = 'open'")
def size_cash(spark, sf_dir):
    return sizing.allocated(held(spark, sf_dir), VALUE).select(F.round("allocated", 4).alias("allocated"))


CTE["later"] = """SELECT h.*, b.d AS bd, b.high, b.low, b.close, row_number() OVER (PARTITION BY h.id ORDER BY b.d) AS holding FROM held h JOIN bars b ON h.ticker = b.ticker AND b.d > h.d"""
CTE["outcome"] = """SELECT id, strategy, ticker, d, entry_price, stop_loss, target_1, target_2, target_3, composite_score, status, max_shares, allocated_dollars, outcome, holding, bd AS outcome_date, exit_price, round((exit_price / entry_price - 1) * 100, 4) AS return_pct FROM (
  SELECT *, CASE outcome WHEN 'stopped' THEN stop_loss WHEN 'hit_t3' THEN target_3 WHEN 'hit_t2' THEN target_2 WHEN 'hit_t1' THEN target_1 ELSE close END AS exit_price FROM (
  SELECT *, CASE WHEN low <= stop_loss THEN 'stopped' WHEN high >= target_3 THEN 'hit_t3' WHEN high >= target_2 THEN 'hit_t2' WHEN high >= target_1 THEN 'hit_t1' WHEN holding >= 20 THEN 'expired' END AS outcome FROM later WHERE holding <= 20) WHERE outcome IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY holding) = 1"""


@query("""SELECT strategy, ticker, d, outcome, holding, outcome_date, return_pct FROM outcome
  WHERE d <= (SELECT max(d) - CASE dayofweek(max(d)) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END - 14 FROM bars)""")
def pos_outcomes(spark, sf_dir):
    """Outcomes of the positions that are ten business days old on the last bar's date."""
    found = bars_with_indicators(spark, sf_dir)
    return positions.outcomes(held(spark, sf_dir, found), found, today=found.select(F.max("d")).scalar())


def last_bars(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    found = indicators.all_indicators(market.bars(spark, sf_dir)) if found is None else found
    return indicators.latest(found).select("ticker", "open", "high", "low", "close", C("atr_proxy").alias("atr"))


CTE["lastbar"] = "SELECT ticker, open, high, low, close, atr_proxy AS atr FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1"
CTE["night"] = """SELECT *, CASE outcome WHEN 'stopped' THEN least(stop_loss, low) WHEN 'hit_t3' THEN target_3 WHEN 'hit_t2' THEN target_2 WHEN 'hit_t1' THEN target_1 END AS exit_price,
  CASE outcome WHEN 'stopped' THEN 1e0 WHEN 'hit_t3' THEN 1e0 WHEN 'hit_t2' THEN 0.3e0 WHEN 'hit_t1' THEN 0.5e0 END AS fraction,
  CASE WHEN outcome IS NULL AND round(greatest(stop_loss, close - 2e0 * atr), 2) > stop_loss THEN round(greatest(stop_loss, close - 2e0 * atr), 2) ELSE stop_loss END AS new_stop FROM (
  SELECT h.*, l.close, l.high, l.low, l.atr, CASE WHEN low <= stop_loss THEN 'stopped' WHEN high >= target_3 THEN 'hit_t3' WHEN high >= target_2 THEN CASE WHEN coalesce(sell_signal_reason, '') NOT LIKE '%Target 2%' THEN 'hit_t2' END
    WHEN high >= target_1 THEN CASE WHEN coalesce(sell_signal_reason, '') NOT LIKE '%Target 1%' THEN 'hit_t1' END END AS outcome FROM held h JOIN lastbar l ON h.ticker = l.ticker WHERE status = 'open')"""


@query("SELECT id, outcome, exit_price, fraction, new_stop AS stop_loss FROM night")
def pos_nightly_eval(spark, sf_dir):
    found = bars_with_indicators(spark, sf_dir)
    return positions.nightly(held(spark, sf_dir, found), last_bars(spark, sf_dir, found)).select("id", "outcome", "exit_price", "fraction", "stop_loss")


@query("""SELECT id, CASE WHEN status = 'open' THEN first_open ELSE entry_price END AS entry_price, round(gap + 1e-9, 4) AS gap_pct, status FROM (SELECT *, CASE WHEN gap > 2 THEN 'cancelled_gap_up' WHEN first_open <= stop_loss THEN 'cancelled_gap_down' ELSE 'open' END AS status
  FROM (SELECT h.* EXCLUDE (status), l.open AS first_open, CASE WHEN entry_price > 0 THEN (l.open / entry_price - 1) * 100 ELSE 0e0 END AS gap FROM held h JOIN lastbar l ON h.ticker = l.ticker WHERE h.status = 'pending'))""")
def pos_pending_gate(spark, sf_dir):
    found = bars_with_indicators(spark, sf_dir)
    return positions.pending_gate(held(spark, sf_dir, found).where("status = 'pending'"), last_bars(spark, sf_dir, found)).select("id", "entry_price", "gap_pct", "status")


_SPLIT = "CASE WHEN due THEN round({c} / ratio + 1e-9, 2) ELSE {c} END AS {c}"


@query(f"""SELECT id, {', '.join(_SPLIT.format(c=c) for c in ('entry_price', 'stop_loss', 'target_1'))}, CASE WHEN due THEN round(max_shares * ratio + 1e-9, 4) ELSE max_shares END AS max_shares, due FROM (
  SELECT h.*, u.ratio, coalesce(u.ratio <> 1, false) AS due FROM held h LEFT JOIN (SELECT ticker, CASE n % 4 WHEN 0 THEN 2e0 WHEN 1 THEN 3e0 ELSE 1e0 END AS ratio FROM universe WHERE n % 2 = 0 OR n % 4 = 1) u ON h.ticker = u.ticker)""")
def pos_split_adjust(spark, sf_dir):
    n = C("n")
    splits = market.universe(spark, sf_dir).where((n % 2 == 0) | (n % 4 == 1)).select("ticker", F.lit("2001-10-29").cast("date").alias("split_date"), F.when(n % 4 == 0, 2.0).when(n % 4 == 1, 3.0).otherwise(1.0).alias("ratio"))
    once = positions.split_adjusted(held(spark, sf_dir), splits)
    rows = positions.split_adjusted(once, splits)  # the second time finds the tag
    return rows.select("id", "entry_price", "stop_loss", "target_1", "max_shares", C("narrative").contains("[SPLIT").alias("due"))


def _exits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = bars_with_indicators(spark, sf_dir)
    rows = held(spark, sf_dir, found)
    decided = positions.nightly(rows, last_bars(spark, sf_dir, found)).where("outcome is not null").select("id", "exit_price", "outcome", "reason", "fraction")
    none = rows.limit(0).select("d", "ticker", F.lit("").alias("outcome"))
    return positions.exit_lots(rows, decided, none, F.lit("2001-11-05").cast("date"))


CTE["lots"] = """SELECT id, d, ticker AS plain, fraction, CASE WHEN fraction = 1 THEN ticker ELSE left(ticker || '-' || upper(replace(outcome, 'hit_', '')), 30) END AS ticker, outcome, exit_price, entry_price,
  CASE WHEN fraction = 1 THEN max_shares ELSE round(max_shares * fraction + 1e-9, 4) END AS shares_sold, CASE WHEN fraction = 1 THEN coalesce(allocated_dollars, 0e0) ELSE round(coalesce(allocated_dollars, 0e0) * fraction + 1e-9, 2) END AS dollars_sold,
  max_shares, allocated_dollars, stop_loss FROM night WHERE outcome IS NOT NULL AND coalesce(max_shares, 0) > 0"""


@query("""SELECT id, d, ticker, outcome, exit_price, shares_sold, dollars_sold, round((exit_price - entry_price) * shares_sold, 4) AS pnl, round((exit_price - entry_price) / entry_price * 100, 4) AS return_pct, greatest(0, DATE '2001-11-05' - d) AS holding_days FROM lots""")
def pos_exit_lots(spark, sf_dir):
    return _exits(spark, sf_dir)[1]


@query("""SELECT id, plain AS ticker, CASE WHEN fraction = 1 THEN 'closed' ELSE 'open' END AS status, CASE WHEN fraction = 1 THEN max_shares ELSE round(max_shares - shares_sold, 4) END AS max_shares,
  CASE WHEN fraction = 1 THEN allocated_dollars ELSE round(allocated_dollars - dollars_sold, 2) END AS allocated_dollars, stop_loss, exit_price AS sell_price FROM lots""")
def pos_exit_changes(spark, sf_dir):
    return _exits(spark, sf_dir)[0].drop("sell_signal_reason")


@query("""SELECT id, round(value, 4) AS value, round(peak, 4) AS peak, round(CASE WHEN peak > 0 THEN (peak - value) / peak * 100 ELSE 0e0 END, 4) AS drawdown_pct FROM (
  SELECT *, greatest(10000e0, max(value) OVER (ORDER BY outcome_date, id)) AS peak FROM (SELECT id, outcome_date, 10000 + sum(round(return_pct, 2)) OVER (ORDER BY outcome_date, id) AS value FROM outcome))""")
def pos_equity_curve(spark, sf_dir):
    """Equity after every outcome, at one unit per percent."""
    found = bars_with_indicators(spark, sf_dir)
    rows = positions.outcomes(held(spark, sf_dir, found), found)
    pnl = rows.select(F.concat_ws(":", "strategy", "ticker", C("d").cast("string")).alias("id"), "outcome_date", F.round("return_pct", 2).alias("pnl"))
    return positions.equity_curve(pnl, ["outcome_date", "id"]).select("id", *(F.round(c, 4).alias(c) for c in ("value", "peak", "drawdown_pct")))


@query("""SELECT id, drawdown, CASE WHEN drawdown < 5 THEN 1e0 WHEN drawdown < 10 THEN 0.75e0 WHEN drawdown < 15 THEN 0.5e0 ELSE 0e0 END AS multiplier FROM (SELECT id, abs(round(return_pct, 2)) AS drawdown FROM outcome)""")
def regime_drawdown(spark, sf_dir):
    """The size multiplier at a drawdown as large as each outcome's return."""
    from tickloom.operators.regime import drawdown_multiplier

    found = bars_with_indicators(spark, sf_dir)
    rows = positions.outcomes(held(spark, sf_dir, found), found).select(F.concat_ws(":", "strategy", "ticker", C("d").cast("string")).alias("id"), F.abs(F.round("return_pct", 2)).alias("drawdown"))
    return rows.withColumn("multiplier", drawdown_multiplier(C("drawdown")))


CTE["strongc"] = "SELECT d, ticker, composite_score + 30 AS composite_score, row_number() OVER (PARTITION BY d ORDER BY composite_score DESC, ticker) AS k FROM deduped WHERE composite_score + 30 >= 85"
CTE["weakc"] = "SELECT d, ticker AS weak_ticker, composite_score AS weak_score, round(200 + composite_score * 5, 2) AS allocated_dollars, row_number() OVER (PARTITION BY d ORDER BY composite_score, ticker) AS k FROM deduped WHERE composite_score <= 55"


@query("""SELECT d, k, ticker, composite_score, weak_ticker, weak_score, allocated_dollars, spread FROM (SELECT *, coalesce(sum(allocated_dollars) OVER (PARTITION BY d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS freed,
  bool_and(spread >= 30) OVER (PARTITION BY d ORDER BY k ROWS UNBOUNDED PRECEDING) AS fits FROM (SELECT s.*, w.weak_ticker, w.weak_score, w.allocated_dollars, s.composite_score - w.weak_score AS spread FROM strongc s JOIN weakc w ON s.d = w.d AND s.k = w.k)) WHERE fits AND 1200 > 500 + freed""")
def pos_rotation(spark, sf_dir):
    best = ranking.best_of_ticker(scan_union(spark, sf_dir)).select("d", "ticker", "composite_score")
    lifted = best.withColumn("composite_score", C("composite_score") + 30)
    return positions.rotation(lifted, best.withColumn("allocated_dollars", F.round(200 + C("composite_score") * 5, 2)), F.lit(1200.0), F.lit(500.0))


@query("SELECT h.id, CASE WHEN l.close > h.entry_price AND round(l.close - CASE WHEN l.atr > 0 THEN 2 * l.atr ELSE l.close * 0.02e0 END, 2) > h.stop_loss THEN round(l.close - CASE WHEN l.atr > 0 THEN 2 * l.atr ELSE l.close * 0.02e0 END, 2) ELSE h.stop_loss END AS stop_loss FROM held h JOIN lastbar l ON h.ticker = l.ticker")
def pos_ratchet_step(spark, sf_dir):
    found = bars_with_indicators(spark, sf_dir)
    rows = held(spark, sf_dir, found).join(last_bars(spark, sf_dir, found), "ticker")
    return rows.select("id", positions.ratchet(C("low"), C("stop_loss"), C("close"), C("entry_price"), C("atr")).alias("stop_loss"))


def _view(spark, sf_dir) -> DataFrame:
    bars = bars_with_indicators(spark, sf_dir)
    metrics = shared.written(wide_metrics(bars), "metrics")
    rows = shared.written(held(spark, sf_dir, bars, metrics), "held")
    found = positions.outcomes(rows, bars).select("strategy", "ticker", "d", "outcome", "outcome_date", "return_pct")
    history = rows.where("status = 'closed'").drop("status", "sell_signal_reason").join(found, ["strategy", "ticker", "d"]).withColumn("exit_price", F.round(C("entry_price") * (1 + C("return_pct") / 100), 4))
    return positions.recommendations(rows, history, metrics.select("ticker", "win_rate", "expectancy_pct", "wins", "losses"))


CTE["view"] = """SELECT v.*, coalesce(m.wins, 0) AS wins, coalesce(m.losses, 0) AS losses, coalesce(m.win_rate, 0e0) AS win_rate, coalesce(m.expectancy_pct, 0e0) AS expectancy_pct, coalesce(m.wins, 0) + coalesce(m.losses, 0) AS total_trades FROM (
  SELECT d, ticker, strategy, entry_price, stop_loss, target_1, target_2, target_3, composite_score, status, sell_signal_reason, NULL AS sell_price, d AS entry_date, NULL AS exit_date FROM held WHERE status = 'open'
  UNION ALL SELECT d, ticker, strategy, entry_price, stop_loss, target_1, target_2, target_3, composite_score, CASE WHEN outcome IN ('stopped', 'hit_t3', 'hit_t2', 'hit_t1', 'closed') THEN 'closed' ELSE outcome END,
    CASE outcome WHEN 'stopped' THEN 'Stop loss hit' WHEN 'hit_t3' THEN 'Target 3 hit – full exit' WHEN 'hit_t2' THEN 'Target 2 hit – sell 30%' WHEN 'hit_t1' THEN 'Target 1 hit – sell 50%' ELSE 'Closed' END,
    round(entry_price * (1 + return_pct / 100), 4), d, outcome_date FROM outcome WHERE status = 'closed') v LEFT JOIN wide m ON v.ticker = m.ticker"""


@query("SELECT * FROM view")
def view_recommendations(spark, sf_dir):
    return _view(spark, sf_dir)


@query("""SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NULL THEN 'missing left' WHEN b.ticker IS NULL THEN 'missing right' ELSE concat_ws(',', CASE WHEN abs(a.win_rate - b.win_rate) > 0.01e0 THEN 'win_rate' END, CASE WHEN abs(a.expectancy_pct - b.expectancy_pct) > 0.01e0 THEN 'expectancy_pct' END) END AS difference
  FROM metrics a FULL JOIN wide b ON a.ticker = b.ticker WHERE a.ticker IS NULL OR b.ticker IS NULL OR abs(a.win_rate - b.win_rate) > 0.01e0 OR abs(a.expectancy_pct - b.expectancy_pct) > 0.01e0""")
def view_validation(spark, sf_dir):
    """Tickers whose stored and recomputed metrics differ."""
    from tickloom.plans.indicator_queries import bt_metrics

    again = wide_metrics(indicators.all_indicators(market.bars(spark, sf_dir)))
    return joins.differing(bt_metrics(spark, sf_dir), again, ["ticker"], ["win_rate", "expectancy_pct"])


@query(f"""SELECT count(*) AS open_positions, round(sum(gain), 4) AS unrealised, round({VALUE} + sum(gain), 4) AS total_value, round(sum(gain) / {VALUE} * 100, 4) AS return_pct FROM (
  SELECT CASE WHEN max_shares > 0 THEN (close - entry_price) * max_shares WHEN allocated_dollars > 0 THEN allocated_dollars * (close / entry_price - 1) ELSE {VALUE * 0.05} * (close / entry_price - 1) END AS gain FROM held h JOIN lastbar l ON h.ticker = l.ticker WHERE status = 'open')""")
def dash_summary(spark, sf_dir):
    """Unrealised gain of open positions by shares, dollars or the 5 % fallback, and total value."""
    found = bars_with_indicators(spark, sf_dir)
    rows = held(spark, sf_dir, found).where("status = 'open'").join(last_bars(spark, sf_dir, found).select("ticker", "close"), "ticker")
    up = C("close") / C("entry_price") - 1
    gain = F.when(C("max_shares") > 0, (C("close") - C("entry_price")) * C("max_shares")).when(C("allocated_dollars") > 0, C("allocated_dollars") * up).otherwise(VALUE * 0.05 * up)
    total = rows.agg(F.count("*").alias("open_positions"), F.sum(gain).alias("g"))
    return total.select("open_positions", F.round("g", 4).alias("unrealised"), F.round(VALUE + C("g"), 4).alias("total_value"), F.round(C("g") / VALUE * 100, 4).alias("return_pct"))


@query("SELECT id, ticker, status, composite_score FROM held WHERE status IN ('open', 'pending')")
def dash_active(spark, sf_dir):
    return held(spark, sf_dir).where(C("status").isin("open", "pending")).select("id", "ticker", "status", "composite_score")


@query("SELECT ticker, d, status, sell_signal_reason, greatest(0, exit_date - entry_date) AS days_held FROM view WHERE status = 'closed' OR status LIKE 'cancelled%'")
def dash_closed(spark, sf_dir):
    rows = _view(spark, sf_dir).where((C("status") == "closed") | C("status").startswith("cancelled"))
    return rows.select("ticker", "d", "status", "sell_signal_reason", F.greatest(F.lit(0), F.datediff("exit_date", "entry_date")).alias("days_held"))


@query("SELECT id, ticker, narrative FROM held WHERE lower(ticker || ' ' || strategy || ' ' || narrative) LIKE '%strong volume%'")
def dash_search(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "ticker", "strategy", "narrative"))
    return held(spark, sf_dir).where(text.contains("strong volume")).select("id", "ticker", "narrative")


@query("SELECT id, ticker, status, composite_score FROM held")
def dash_sorted(spark, sf_dir):
    """All positions in the dashboard's order: the best score first, rows without one last."""
    return in_order(held(spark, sf_dir).select("id", "ticker", "status", "composite_score"), "composite_score", descending=True)


@query("SELECT DISTINCT d, CASE dayofweek(d) WHEN 5 THEN d + 3 WHEN 6 THEN d + 2 ELSE d + 1 END AS next_day FROM (SELECT CAST(ts AS DATE) AS d FROM events)")
def cal_next_trading_day(spark, sf_dir):
    days = market.table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    return days.select("d", calendar.next_trading_day(C("d")).alias("next_day"))


@query("SELECT event_id, isodow(l) < 6 AND hour(l) BETWEEN 4 AND 19 AS open FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events)")
def cal_market_open(spark, sf_dir):
    """January events: New York is five hours behind; no listed holiday falls in their year."""
    return market.table(spark, sf_dir, "events").select("event_id", calendar.market_open(C("ts").cast("timestamp")).alias("open"))


_MARCH, _NOVEMBER = (f"make_date(year(u), {m}, {d}) + CAST((7 - isodow(make_date(year(u), {m}, {d}))) % 7 AS INTEGER) + INTERVAL {h} HOUR" for m, d, h in ((3, 8, 7), (11, 1, 6)))


@query(f"""SELECT event_id, u AS at, isodow(l) < 6 AND CAST(CAST(l AS DATE) AS VARCHAR) NOT IN ({', '.join(repr(d) for d in calendar.HOLIDAYS)}) AND hour(l) BETWEEN 4 AND 19 AS open
  FROM (SELECT *, u - CASE WHEN u >= {_MARCH} AND u < {_NOVEMBER} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS l FROM (SELECT event_id, ts + INTERVAL 1 DAY * (event_id % 1461) AS u FROM events))""")
def cal_market_hours(spark, sf_dir):
    """Events spread over four years: clock changes (second Sunday in March, first in November), holidays and weekends."""
    at = (C("ts").cast("timestamp") + F.make_dt_interval(days=(C("event_id") % 1461).cast("int"))).alias("at")
    rows = market.table(spark, sf_dir, "events").select("event_id", at)
    return rows.select("event_id", C("at").cast("timestamp_ntz").alias("at"), calendar.market_open(C("at")).alias("open"))


@query("""SELECT d, (SELECT max(b) FROM (SELECT b, row_number() OVER (ORDER BY b DESC) AS n FROM (SELECT CAST(unnest(range(e.d - 20, e.d + 1, INTERVAL 1 DAY)) AS DATE) AS b) WHERE isodow(b) < 6) WHERE n = 11) AS ago FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) e""")
def cal_bday_ago(spark, sf_dir):
    days = market.table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    return days.select("d", calendar.business_days_ago(C("d"), 10).alias("ago"))


@query("""SELECT ticker, company_name, industry, source FROM (SELECT upper(replace(trim(raw), '#', '-')) AS ticker, company_name, industry, source, row_number() OVER (PARTITION BY upper(replace(trim(raw), '#', '-')) ORDER BY source) AS k FROM (
  SELECT ' ' || lower(ticker) AS raw, company_name, industry, 'a' AS source FROM universe WHERE n % 2 = 0 UNION ALL SELECT ticker, company_name, industry, 'b' FROM universe WHERE n % 3 = 0)) WHERE k = 1 AND ticker NOT IN ('BRAND-1')""")
def universe_merge(spark, sf_dir):
    """Two lists merged into a clean universe."""
    named = market.universe(spark, sf_dir)
    a = named.where("n % 2 = 0").select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), "company_name", "industry", F.lit("a").alias("source"))
    b = named.where("n % 3 = 0").select("ticker", "company_name", "industry", F.lit("b").alias("source"))
    return tables.merged_universe(a, b, blacklist=["BRAND-1"], dot="#")
