"""Queries over final rows, keyed tables and as-of lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import final, joins, positions, ranking
from tickloom.plans import oracle
from tickloom.plans.indicator_queries import C, bt_metrics, query
from tickloom.plans.position_queries import CASH, SHARES, SIZED, VALUE, held
from tickloom.plans.signal_queries import context_scores, handed, percent_up, pool, scan_union
from tickloom.sources import market, shared, tables

CTE = oracle.CTE
KEYS = "strategy, ticker, d"


@query(f"""SELECT {KEYS}, round(CASE r.regime WHEN 'bull' THEN 0.3e0 * momentum_score + 0.3e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score + 0.15e0 * context_score
  WHEN 'bear' THEN 0.15e0 * momentum_score + 0.35e0 * expectancy_score + 0.1e0 * winrate_score + 0.1e0 * regime_score + 0.3e0 * context_score
  ELSE 0.25e0 * momentum_score + 0.35e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score + 0.15e0 * context_score END, 4) AS rank_score FROM ranked r JOIN ctx USING (ticker)""")
def rank_with_context(spark, sf_dir):
    return final.with_context(ranking.scores(pool(spark, sf_dir)), context_scores(spark, sf_dir)).select("strategy", "ticker", "d", "rank_score")


CTE["old1"] = """SELECT *, (least(greatest(100 - 4 * abs(current_rsi - 50), 0e0), 100e0) + 100e0 + least(greatest(50 * volume_ratio, 0e0), 100e0) + 50e0) / 4 AS rm FROM pool0"""
CTE["old2"] = """SELECT o.strategy, o.ticker, o.d, rm, (rank() OVER (PARTITION BY o.strategy, o.d ORDER BY rm) + (count(*) OVER (PARTITION BY o.strategy, o.d, rm) - 1) / 2e0) / count(*) OVER (PARTITION BY o.strategy, o.d) * 100 / (1 + exp(-(rm - 55) / 5)) AS m, r.expectancy_score, r.winrate_score
  FROM old1 o JOIN ranked r ON o.strategy = r.strategy AND o.ticker = r.ticker AND o.d = r.d"""


@query(f"SELECT {KEYS}, round(0.3e0 * m + 0.3e0 * expectancy_score + 0.15e0 * winrate_score, 4) AS rank_score FROM old2")
def rank_compatible(spark, sf_dir):
    """The old interface: the price stands for its mean, so no regime points can be had."""
    return final.compatible(pool(spark, sf_dir)).select("strategy", "ticker", "d", "rank_score")


CTE["ranked_ctx"] = """SELECT r.*, context_score, round(CASE r.regime WHEN 'bull' THEN 0.3e0 * momentum_score + 0.3e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score + 0.15e0 * context_score
  WHEN 'bear' THEN 0.15e0 * momentum_score + 0.35e0 * expectancy_score + 0.1e0 * winrate_score + 0.1e0 * regime_score + 0.3e0 * context_score
  ELSE 0.25e0 * momentum_score + 0.35e0 * expectancy_score + 0.15e0 * winrate_score + 0.1e0 * regime_score + 0.15e0 * context_score END, 4) AS score FROM ranked r JOIN ctx USING (ticker)"""
CTE["tiers_ctx"] = """SELECT *, CASE WHEN score >= CASE WHEN regime = 'bull' THEN 80 ELSE 75 END AND (regime <> 'bear' OR context_score > 50) AND expectancy_pct > 0 AND win_rate >= 35 AND total_signals >= 10 THEN 1
  WHEN score >= 50 AND expectancy_pct >= 0 AND win_rate >= 25 AND total_signals >= 10 THEN 2 WHEN score >= 40 AND expectancy_pct >= -2 THEN 3 ELSE 4 END AS tier FROM ranked_ctx"""


@query(f"""SELECT {KEYS}, context_score, tier, row_number() OVER (PARTITION BY strategy, d ORDER BY CASE WHEN firsts >= 3 THEN tier ELSE 0 END, score DESC, ticker) AS place
  FROM (SELECT * REPLACE (round(context_score, 6) AS context_score), count(*) FILTER (tier = 1) OVER (PARTITION BY strategy, d) AS firsts FROM tiers_ctx WHERE tier <= 2)""")
def rank_tiers_context(spark, sf_dir):
    """Tiers with context: in a bear regime only a context score over 50 opens tier 1."""
    scored = final.with_context(ranking.scores(pool(spark, sf_dir)), context_scores(spark, sf_dir))
    return ranking.tiered(scored).select("strategy", "ticker", "d", F.round("context_score", 6).alias("context_score"), "tier", "place")


@query(f"SELECT {KEYS}, CASE WHEN n % 2 = 0 THEN 40e0 ELSE round(context_score, 6) END AS context_score FROM ranked JOIN universe USING (ticker) JOIN ctx USING (ticker)")
def rank_late_context(spark, sf_dir):
    """Rows that were ranked without context get it late; those that have a score (here 40, for every other ticker) keep it."""
    universe = market.universe(spark, sf_dir)
    early = pool(spark, sf_dir).join(universe.select("ticker", F.when(C("n") % 2 == 0, 40.0).otherwise(0.0).alias("context_score")), "ticker")
    found = final.with_context(ranking.scores(early), context_scores(spark, sf_dir))
    return found.select("strategy", "ticker", "d", F.round("context_score", 6).alias("context_score"))


CTE["open_then"] = "SELECT DISTINCT upper(ticker) AS ticker, d + 7 AS d FROM held WHERE status = 'open'"
CTE["best3"] = """SELECT c.* REPLACE (greatest(stop_loss, round(entry_price * 0.93e0, 2)) AS stop_loss), least(10000e0 * greatest(0e0, (p - (1 - p) / rr) / 2), 500e0) AS wanted FROM (SELECT *, CASE WHEN composite_score >= 90 THEN 0.75e0 WHEN composite_score >= 80 THEN 0.68e0
    WHEN composite_score >= 70 THEN 0.6e0 WHEN composite_score >= 60 THEN 0.52e0 WHEN composite_score >= 50 THEN 0.45e0 ELSE 0.35e0 END AS p, CASE WHEN weighted_rr > 0 THEN weighted_rr ELSE 2e0 END AS rr
  FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY composite_score DESC, ticker) AS place FROM (SELECT *, max(composite_score) OVER (PARTITION BY d) AS best FROM chosen) WHERE best < 80 OR composite_score >= 80)
  WHERE place <= 3) c WHERE NOT EXISTS (SELECT 1 FROM open_then o WHERE o.ticker = upper(c.ticker) AND o.d = c.d)"""
_RAISED = ", ".join(f"CASE WHEN target_1 <= entry_price THEN {percent_up('entry_price', p)} ELSE target_{k} END AS target_{k}" for k, p in ((1, 7), (2, 12), (3, 18)))


@query(f"""SELECT d, ticker, strategy, place, stop_loss, {_RAISED}, allocated_dollars, {SHARES} AS max_shares, {SIZED} AS position_sizing, CASE dayofweek(d) WHEN 5 THEN d + 3 WHEN 6 THEN d + 2 ELSE d + 1 END AS entry_date, 'pending' AS status
  FROM (SELECT *, round(wanted * CASE WHEN sum(wanted) OVER (PARTITION BY d) > {CASH} THEN {CASH} / sum(wanted) OVER (PARTITION BY d) ELSE 1e0 END, 2) AS allocated_dollars FROM best3)""")
def final_recommended(spark, sf_dir):
    """The rows of a nightly run: unblocked, capped, best of each ticker, gated, not already held (opened a week before), within the stop ceiling, sized."""
    signals = shared.written(scan_union(spark, sf_dir), "signals")
    open_then = held(spark, sf_dir).where("status = 'open'").select("ticker", F.date_add("d", 7).alias("d"))
    rows = final.recommended(signals, VALUE, CASH, positions=open_then)
    return rows.select("d", "ticker", "strategy", "place", "stop_loss", "target_1", "target_2", "target_3", "allocated_dollars", "max_shares", "position_sizing", "entry_date", "status")


_PRESENT = {"scan_date": "CAST(d AS VARCHAR)", "is_fallback": "false", "is_blocked": "false", "blocked_reason": "CAST(NULL AS VARCHAR)", "regime": "coalesce(regime, 'bull')", "position_sizing": "'50/30/20'", "tier_label": "coalesce(tier_label, 'Unrated')",
            "target_1": "target_1", "target_2": "target_2", "target_3": "target_3"}
_PRESENT |= {c: f"coalesce({c}, 0e0)" for c in ("price", "entry_price", "stop_loss", "upside_pct", "current_rsi", "volume_ratio", "adx_value", "composite_score", "quality_score", "weighted_rr")}
_PRESENT |= {c: f"coalesce({c}, '')" for c in ("ticker", "narrative", "strategy")}
_ABSENT = {"string": "''", "double": "0e0", "int": "0"}


@query("SELECT " + ", ".join(f"{_PRESENT.get(n, _ABSENT.get(k))} AS {n}" for n, (k, _) in final.CANDIDATE.items()) + " FROM handed")
def final_candidates(spark, sf_dir):
    """All 45 fields of the signals that the scans hand on."""
    return final.candidates(handed(spark, sf_dir))


@query("SELECT h.d, count(o.outcome) AS rated, count(*) FILTER (o.outcome IS NULL) AS unrated, round(avg(o.return_pct) + 1e-8, 4) AS mean_return FROM held h LEFT JOIN outcome o ON h.id = o.id GROUP BY h.d")
def hist_rollup(spark, sf_dir):
    rows = shared.written(held(spark, sf_dir), "held")
    rated = positions.outcomes(rows, market.bars(spark, sf_dir)).select("strategy", "ticker", "d", "outcome", "return_pct")
    return final.history_rollup(rows.select("strategy", "ticker", "d").join(rated, ["strategy", "ticker", "d"], "left"))


@query("""SELECT m.ticker, m.day, arg_max(b.close, b.d) AS close, max(b.d) AS bar_date FROM (SELECT DISTINCT ticker, CAST(date_trunc('month', d) AS DATE) + 10 AS day FROM bars) m LEFT JOIN bars b ON m.ticker = b.ticker AND b.d <= m.day GROUP BY 1, 2""")
def join_as_of(spark, sf_dir):
    """Each ticker's last bar at or before the 11th of every month that it trades in."""
    bars = market.bars(spark, sf_dir)
    wanted = bars.select("ticker", F.date_add(F.trunc("d", "month"), 10).alias("day")).distinct()
    return joins.as_of(wanted, bars.withColumn("bar_date", C("d")), "ticker", "day", "d", ["close", "bar_date"])


@query("""SELECT ticker, total_signals, win_rate FROM wide UNION ALL SELECT ticker, total_signals, win_rate FROM metrics WHERE ticker NOT IN (SELECT ticker FROM wide)""")
def table_upsert(spark, sf_dir):
    """Stored metrics with the recomputed ones in place of theirs."""
    from tickloom.operators import indicators
    from tickloom.plans.signal_queries import wide_metrics

    bars = market.bars(spark, sf_dir)
    new = wide_metrics(indicators.all_indicators(bars)).select("ticker", "total_signals", "win_rate")
    return tables.upserted(bt_metrics(spark, sf_dir).select("ticker", "total_signals", "win_rate"), new, ["ticker"])


@query("SELECT h.id, coalesce(n.new_stop, h.stop_loss) AS stop_loss, h.entry_price FROM held h LEFT JOIN night n ON h.id = n.id")
def table_update(spark, sf_dir):
    """Positions with the stops that the nightly evaluation raised."""
    from tickloom.plans.position_queries import last_bars

    rows = shared.written(held(spark, sf_dir), "held")
    changes = positions.nightly(rows, last_bars(spark, sf_dir)).select("id", "stop_loss")
    return tables.updated(rows.select("id", "stop_loss", "entry_price"), changes, ["id"])


@query("SELECT f.ticker, f.sector, count(u.ticker) AS members FROM (VALUES " + ", ".join(f"('{t}', '{s}')" for t, s in market.SECTOR_FUNDS) + ") f(ticker, sector) LEFT JOIN universe u ON u.industry = f.sector GROUP BY 1, 2")
def universe_funds(spark, sf_dir):
    """The sector funds, and how many tickers of the universe are of each one's sector."""
    return market.fund_members(spark, market.universe(spark, sf_dir))


@query("SELECT ticker, month, count(*) AS bars FROM (SELECT ticker, strftime(d, '%Y-%m') AS month FROM bars) GROUP BY ALL")
def bars_by_month(spark, sf_dir):
    """Bars in each partition of a store by month."""
    return market.bars(spark, sf_dir).groupBy("ticker", tables.month(C("d")).alias("month")).agg(F.count("*").alias("bars"))


# --- stores and keyed tables that are really written and read back ------------------------------------


def store(bars, name: str) -> str:
    path = f"{shared.shared_folder(bars.sparkSession)}/tickloom/{name}-{uuid.uuid4().hex}"
    tables.write_bars(bars, path)
    return path


@query("SELECT ticker, d, open, high, low, close, volume FROM bars WHERE d BETWEEN DATE '2000-02-10' AND DATE '2000-08-20'")
def store_range(spark, sf_dir):
    """A range of dates out of a store by month: other months are never opened."""
    return tables.read_bars(spark, store(market.bars(spark, sf_dir), "bars"), "2000-02-10", "2000-08-20")


@query("SELECT ticker, d, open, high, low, close, volume FROM bars WHERE d >= DATE '1999-03-01' AND d < DATE '1999-06-01'")
def store_slice(spark, sf_dir):
    """A slice that leaves its last date out."""
    return tables.read_bars(spark, store(market.bars(spark, sf_dir), "bars"), "1999-03-01", "1999-06-01", end_exclusive=True)


@query("SELECT ticker, d, open, high, low, close, volume FROM bars WHERE d = (SELECT max(d) FROM bars)")
def store_one_date(spark, sf_dir):
    """All tickers of the last date, from that date's month alone."""
    bars = market.bars(spark, sf_dir)
    last = str(bars.agg(F.max("d")).first()[0])
    return tables.read_bars(spark, store(bars, "bars"), last, last)


@query("SELECT ticker, count(*) AS bars, max(d) AS last FROM bars GROUP BY ticker")
def store_refresh(spark, sf_dir):
    """A store that ends in 1997 is brought up to date by the later bars only."""
    bars = market.bars(spark, sf_dir)
    path = store(bars.where("d <= date'1997-06-10'"), "bars")
    tables.refresh(spark, path, bars)
    return tables.read_bars(spark, path).groupBy("ticker").agg(F.count("*").alias("bars"), F.max("d").alias("last"))


@query("""SELECT 'force' AS mode, count(*) AS bars, min(d) AS first, max(d) AS last FROM bars WHERE d >= DATE '1996-06-01'
  UNION ALL SELECT mode, count(*), min(d), max(d) FROM bars, (VALUES ('incremental'), ('local')) m(mode) GROUP BY mode
  UNION ALL SELECT 'local, fresh', count(*), min(d), max(d) FROM bars WHERE d <= DATE '1997-06-10'""")
def store_refresh_modes(spark, sf_dir):
    """A store that ends in June 1997 meets bars since June 1996 in each mode, and in local mode also on the next day."""
    bars, found = shared.written(market.bars(spark, sf_dir), "bars"), None
    for label, today in (("force", "2001-10-30"), ("incremental", "2001-10-30"), ("local", "2001-10-30"), ("local, fresh", "1997-06-10")):
        path = store(bars.where("d <= date'1997-06-10'"), "bars")
        tables.brought_up(spark, path, bars.where("d >= date'1996-06-01'"), tables.refresh_mode(label.partition(",")[0]), today)
        rows = tables.read_bars(spark, path).agg(F.count("*").alias("bars"), F.min("d").alias("first"), F.max("d").alias("last")).select(F.lit(label).alias("mode"), "bars", "first", "last")
        found = found.union(rows) if found else rows
    return found


@query("SELECT ticker, min(d) <= DATE '1994-01-01' AND max(d) >= DATE '2000-01-01' AS covered FROM bars GROUP BY ticker")
def store_coverage(spark, sf_dir):
    """Whether each ticker's stored bars reach over a range."""
    return tables.covers(market.bars(spark, sf_dir), "1994-01-01", "2000-01-01")


@query("""SELECT w.ticker, total_signals FROM wide w JOIN (SELECT ticker, d FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY close DESC, d DESC) = 1) s ON w.ticker = s.ticker
  WHERE DATE '2001-10-30' - s.d BETWEEN 0 AND 1200""")
def metrics_current(spark, sf_dir):
    """Cached metrics within their lifetime: 1200 days before the end of October 2001, stamped with each ticker's day of highest close."""
    from tickloom.operators import indicators
    from tickloom.plans.signal_queries import wide_metrics

    bars = market.bars(spark, sf_dir)
    stamps = bars.groupBy("ticker").agg(F.max(F.struct("close", "d")).getField("d").alias("updated"))
    stored = wide_metrics(indicators.all_indicators(bars)).join(stamps, "ticker")
    return tables.current(stored, "updated", F.lit("2001-10-30").cast("timestamp"), 24 * 1200).select("ticker", "total_signals")


@query("SELECT id, status, entry_price FROM held WHERE status = 'open' UNION ALL SELECT 'new:' || strategy || ':' || ticker || ':' || d, 'pending', entry_price FROM chosen")
def table_insert(spark, sf_dir):
    """The nightly insert: rows that are not open go, and the new signals come in as pending."""
    rows = held(spark, sf_dir).select("id", "status", "entry_price")
    best = ranking.best_of_ticker(handed(spark, sf_dir))
    new = best.select(F.concat_ws(":", F.lit("new"), "strategy", "ticker", C("d").cast("string")).alias("id"), F.lit("pending").alias("status"), "entry_price")
    return tables.inserted(rows, new, C("status") == "open")


@query("SELECT h.id, coalesce(o.outcome, 'open') AS outcome, o.return_pct, o.holding FROM held h LEFT JOIN outcome o ON h.id = o.id")
def hist_update(spark, sf_dir):
    """The history with outcome, return and holding days of the signals that have been decided."""
    rows = shared.written(held(spark, sf_dir), "held")
    history = rows.select("id", F.lit("open").alias("outcome"), F.lit(None).cast("double").alias("return_pct"), F.lit(None).cast("int").alias("holding"))
    found = positions.outcomes(rows, market.bars(spark, sf_dir)).select(F.concat_ws(":", "strategy", "ticker", C("d").cast("string")).alias("id"), "outcome", "return_pct", "holding")
    return tables.updated(history, found, ["id"])


@query("SELECT ticker, d, CASE WHEN t % 5 = 0 THEN open WHEN t % 3 = 0 THEN high WHEN t % 2 = 0 THEN low ELSE close END AS price FROM bars")
def quote_preferred(spark, sf_dir):
    """One price out of four sources, some of which have none or zero."""
    t = C("t")
    rows = market.bars(spark, sf_dir).withColumns({"a": F.when(t % 5 == 0, C("open")), "b": F.when(t % 3 == 0, C("high")).otherwise(0.0), "c": F.when(t % 2 == 0, C("low")), "e": C("close")})
    return rows.select("ticker", "d", tables.quote("a", "b", "c", "e").alias("price"))


@query("SELECT ticker, d, close, volume FROM bars")
def csv_round_trip(spark, sf_dir):
    """Bars out to CSV files and back in a stated schema."""
    path = f"{shared.shared_folder(spark)}/tickloom/csv-{uuid.uuid4().hex}"
    tables.export_csv(market.bars(spark, sf_dir).select("ticker", "d", "close", "volume"), path)
    return tables.read_csv(spark, path, "ticker string, d date, close double, volume double")


@query("""SELECT id, '{"ticker":"' || ticker || '","outcome":"' || outcome || '","fraction":' || CAST(fraction AS VARCHAR) || '}' AS result FROM night WHERE outcome IS NOT NULL""")
def pos_exit_json(spark, sf_dir):
    """The nightly exits as JSON, as a caller of the exit step receives them."""
    from tickloom.plans.position_queries import last_bars

    exits = positions.nightly(held(spark, sf_dir), last_bars(spark, sf_dir)).where("outcome is not null")
    return exits.select("id", positions.as_json("ticker", "outcome", "fraction").alias("result"))


@query("""SELECT count(*) AS years, count(*) FILTER (mean > 0) AS profitable_years, round(sum(h) / nullif(sum(n), 0) + 1e-8, 4) AS average_holding
  FROM (SELECT year(d) AS y, avg(return_pct) AS mean, sum(holding) AS h, count(holding) AS n FROM wide_trades WHERE outcome IS NOT NULL GROUP BY 1)""")
def bt_profitable_years(spark, sf_dir):
    """Years with trades, those with a positive mean return, and the average holding of all trades."""
    from tickloom.operators import backtest, indicators

    bars = market.bars(spark, sf_dir)
    trades = backtest.simulate(backtest.signals(indicators.all_indicators(bars), use=("trend",)), bars)
    return backtest.profitable_years(trades)
