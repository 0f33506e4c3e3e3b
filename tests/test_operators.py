"""Operators against loops and hand-computed values."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import in_order, percentile_rank
from tickloom.functions.recursive import decayed_sums, ema, from_first, wilder_sum
from tickloom.operators import backtest, calendar, context, final, indicators, joins, positions, ranking, regime, sizing
from tickloom.sources import shared, tables
from tickloom.streaming import ticks


def series(spark, values, ticker="A"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(ticker, day + dt.timedelta(days=i), float(v), i) for i, v in enumerate(values)], "ticker string, d date, x double, t long")


@pytest.mark.parametrize("n", [1, 20, 1300])
def test_filters_equal_loops_over_several_blocks(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).cumsum() + 50
    rows = decayed_sums(series(spark, x), {"e": ema(F.col("x"), 14), "w": wilder_sum(F.col("x"), 14)}).withColumn("w", from_first("w", F.col("x"), 14))
    found = rows.orderBy("t").toPandas()
    assert np.allclose(found.e, pd.Series(x).ewm(span=14, adjust=False).mean(), rtol=1e-12)
    want = np.full(n, x[:14].sum())
    for t in range(14, n):
        want[t] = want[t - 1] * (1 - 1 / 14) + x[t]
    assert np.allclose(found.w, want, rtol=1e-12)


def bars(spark, rows):
    return spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, r), 100.0, i) for i, r in enumerate(rows)], "ticker string, d date, open double, high double, low double, close double, volume double, t long")


def test_rsi_is_null_without_losses_and_adx_tie_rule(spark):
    found = indicators.all_indicators(bars(spark, [(i, i + 1, i - 1, i + 0.5) for i in range(10, 40)])).orderBy("t").toPandas()
    assert found.rsi_14.isna().all() and (found.n_bars == range(1, 31)).all()
    # equal moves up and down: the plus move is dropped, the minus move stays
    moved = indicators.moves(bars(spark, [(10, 11, 9, 10), (10, 12, 8, 10)])).orderBy("t").toPandas()
    assert moved.dm_plus.tolist() == [0, 0] and moved.dm_minus.tolist() == [0, 1]


CASES = {
    "no trigger": ([(99, 99.5, 98, 99)] * 6, None),
    "fill at a higher open": ([(101, 102, 100, 101), (110, 116, 109, 115)], ("win", (115 / 101 - 1) * 100 - 0.1)),
    "stop before target on one bar": ([(100, 101, 99, 100), (100, 116, 94, 100)], ("loss", (95 / 100 - 1) * 100 - 0.1)),
    "gap under the stop": ([(100, 101, 99, 100), (90, 91, 89, 90)], ("loss", (90 / 100 - 1) * 100 - 0.1)),
    "gap over the target": ([(100, 101, 99, 100), (120, 121, 119, 120)], ("win", (120 / 100 - 1) * 100 - 0.1)),
    "stop on the entry bar": ([(99, 101, 94, 96)], ("loss", (95 / 100 - 1) * 100 - 0.1)),
    "never exits": ([(100, 101, 99, 100)] * 8, None),
}


@pytest.mark.parametrize("name", CASES)
def test_trade_simulation(spark, name):
    later, want = CASES[name]
    signal = spark.createDataFrame([("A", dt.date(2020, 1, 1), 0, 100.0, 95.0, 115.0)], "ticker string, d date, t long, entry double, stop double, target double")
    row = backtest.simulate(signal, bars(spark, [(98, 99, 97, 98), *later])).first()
    assert (row.outcome, row.return_pct) == ((None, None) if want is None else (want[0], pytest.approx(want[1])))


POOL = [
    ("ABNB", 20.0, -3.41, 140.0, 135.0, 56.1, 1.10, 0.12, 15, "Hotels"), ("AEE", 18.5, -0.59, 80.0, 82.0, 53.9, 1.17, -0.05, 12, "Multi-Utilities"),
    ("BALL", 24.1, -0.60, 60.0, 58.0, 60.3, 2.33, 0.22, 10, "Containers"), ("TSLA", 45.0, 5.1, 250.0, 240.0, 52.0, 1.5, 0.45, 22, "Automobile"),
    ("NVDA", 38.0, 4.2, 120.0, 110.0, 68.0, 2.0, 0.35, 30, "Semiconductors"), ("INVALID", 10.0, -5.0, 10.0, 15.0, 30.0, 0.5, -0.20, 2, "Unknown"),
    ("XYZ", 40.0, 3.5, 100.0, 95.0, 55.0, 1.2, 0.20, 15, "Semiconductors"),
]
COMPOSITE = {"TSLA": 77.9324, "XYZ": 64.5219, "NVDA": 54.7072, "BALL": 48.1914, "ABNB": 34.4640, "AEE": 16.2316, "INVALID": 3.6440}


def test_ranker_fixture(spark):
    pool = spark.createDataFrame(POOL, "ticker string, win_rate double, expectancy_pct double, price double, dma_50 double, current_rsi double, volume_ratio double, macd_hist double, total_signals int, industry string")
    scored = ranking.scores(pool.withColumns({"strategy": F.lit("pullback"), "d": F.lit("2020-01-01").cast("date"), "regime": F.lit("bull")}))
    assert {r.ticker: r.rank_score for r in scored.collect()} == pytest.approx(COMPOSITE, abs=2e-4)
    assert [r.ticker for r in ranking.tiered(scored).orderBy("place").collect()] == ["TSLA", "XYZ", "NVDA"]


def test_percentile_rank_of_ties_and_of_one(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 2.0), ("p", 3.0), ("q", 9.0)], "g string, x double").select("g", "x", percentile_rank(F.col("x"), "g").alias("r"))
    assert sorted((r.g, r.x, r.r) for r in rows.collect()) == [("p", 1.0, 25.0), ("p", 2.0, 62.5), ("p", 2.0, 62.5), ("p", 3.0, 100.0), ("q", 9.0, 100.0)]


def test_as_of_looks_back_and_forward(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y")], "k string, rt int, v string")
    back = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "rt", ["v"]).collect()}
    ahead = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "rt", ["v"], forward=True).collect()}
    assert back == {("a", 1): None, ("a", 5): "x", ("a", 9): "y", ("b", 5): None}
    assert ahead == {("a", 1): "x", ("a", 5): "y", ("a", 9): None, ("b", 5): None}


def position(spark, **changes):
    row = {"id": "1", "ticker": "A", "d": dt.date(2024, 1, 2), "entry_price": 100.0, "stop_loss": 95.0, "target_1": 107.0, "target_2": 112.0, "target_3": 118.0, "status": "open",
           "sell_signal_reason": None, "max_shares": 10.0, "allocated_dollars": 1000.0, "narrative": None} | changes
    kinds = {"d": "date"} | {c: "double" for c in ("entry_price", "stop_loss", "target_1", "target_2", "target_3", "max_shares", "allocated_dollars")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


@pytest.mark.parametrize(
    ("bar", "reason", "want"),
    [((96.0, 108.0, 94.0), None, ("stopped", 94.0)), ((100.0, 119.0, 99.0), None, ("hit_t3", 118.0)), ((100.0, 113.0, 99.0), None, ("hit_t2", 112.0)), ((100.0, 108.0, 99.0), None, ("hit_t1", 107.0)),
     ((100.0, 108.0, 99.0), "Target 1 hit – sell 50%", (None, None)), ((106.0, 106.5, 99.0), None, (None, None))],
)
def test_nightly_precedence(spark, bar, reason, want):
    last = spark.createDataFrame([("A", *bar, 2.0)], "ticker string, close double, high double, low double, atr double")
    row = positions.nightly(position(spark, sell_signal_reason=reason), last).first()
    assert (row.outcome, row.exit_price) == want
    assert row.stop_loss == (95.0 if want[0] or bar[0] - 4 <= 95 else bar[0] - 4)


def test_partial_exit_is_a_lot_and_is_not_repeated(spark):
    exits = spark.createDataFrame([("1", 107.0, "hit_t1", "r", 0.5)], "id string, exit_price double, outcome string, reason string, fraction double")
    none = spark.createDataFrame([], "d date, ticker string, outcome string")
    changed, lots = positions.exit_lots(position(spark), exits, none, F.lit("2024-01-10").cast("date"))
    lot, row = lots.first(), changed.first()
    assert (lot.ticker, lot.shares_sold, lot.dollars_sold, lot.pnl, lot.holding_days) == ("A-T1", 5.0, 500.0, 35.0, 8)
    assert (row.status, row.max_shares, row.allocated_dollars) == ("open", 5.0, 500.0)
    assert positions.exit_lots(position(spark), exits, lots, F.lit("2024-01-10").cast("date"))[1].count() == 0


def test_equity_peak_never_falls(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.uniform(-50, 50)) for i in range(60)], "n int, pnl double")
    found = positions.equity_curve(rows, ["n"]).orderBy("n").toPandas()
    assert (found.peak.diff().dropna() >= 0).all() and (found.drawdown_pct >= 0).all() and found.value.iloc[-1] == pytest.approx(10000 + found.pnl.sum())


def test_sizes_stay_within_cash_and_cap(spark):
    rows = spark.createDataFrame([(str(i), 0.2, 50.0, 10000.0, 900.0) for i in range(4)], "ticker string, fraction double, entry_price double, portfolio_value double, cash double")
    found = sizing.normalised(rows.withColumn("d", F.lit(1)), "d").toPandas()
    assert found.allocated_dollars.sum() <= 900.01 and (found.allocated_dollars <= 500).all()
    labels = spark.createDataFrame([("50/30/20", 5.0), ("K: 3.2% (0.88 sh)", 3.2), ("Kelly: 11.2%", 5.0), ("", 5.0), (None, 5.0), ("what", 5.0)], "s string, want double")
    assert all(r.got == r.want for r in labels.select("want", sizing.parsed_percent(F.col("s")).alias("got")).collect())


def test_calendar(spark):
    days = spark.createDataFrame([("2024-01-05", "2024-01-08"), ("2024-01-06", "2024-01-08"), ("2024-01-07", "2024-01-08"), ("2024-01-08", "2024-01-09")], "d string, want string")
    assert all(r.got == r.want for r in days.select("want", calendar.next_trading_day(F.col("d").cast("date")).cast("string").alias("got")).collect())
    want = [str(x.date()) for x in (pd.Timestamp("2024-03-13") - pd.offsets.BDay(n) for n in range(13))]
    got = spark.range(1).select(*(calendar.business_days_ago(F.lit("2024-03-13").cast("date"), n).cast("string").alias(f"n{n}") for n in range(13))).first()
    assert list(got) == want
    at = spark.createDataFrame([("2025-07-04 15:00:00", False), ("2025-07-03 15:00:00", True), ("2025-07-03 07:59:00", False), ("2025-07-05 15:00:00", False)], "ts string, want boolean")
    assert all(r.got == r.want for r in at.select("want", calendar.market_open(F.col("ts").cast("timestamp")).alias("got")).collect())


def test_regime_bounds(spark):
    found = regime.sma_regime(series(spark, [100] * 200 + [110]).withColumnRenamed("x", "close")).orderBy("d").toPandas()
    assert found.regime.tolist()[:199] == ["bull"] * 199 and found.regime.tolist()[199:] == ["sideways", "bull"]


def test_hmm_finds_separated_states():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.2, (80, 2)) for m in (-1, 0, 1)])
    model = regime.fit_hmm(x)
    path = regime.best_path(x, *model)
    assert sorted(model[2][:, 0].round(0).tolist()) == [-1, 0, 1] and len(set(path[:80])) == len(set(path[160:])) == 1


def test_blocks_of_a_series_give_the_beliefs_of_the_plain_recursion():
    rng = np.random.default_rng(3)
    for rows in (1, 2, 3, 30, 97, 1000):
        likely, move, start = rng.random((rows, 3)) ** 6, rng.random((3, 3)) ** 4, np.array([0.2, 0.5, 0.3])
        move /= move.sum(axis=1, keepdims=True)
        ahead, behind = [start * likely[0] / (start * likely[0]).sum()], [np.ones(3)]
        for seen in likely[1:]:
            now = seen * (ahead[-1] @ move)
            ahead.append(now / now.sum())
        for seen in likely[:0:-1]:
            now = move @ (seen * behind[-1])
            behind.append(now / now.sum())
        belief = np.array(ahead) * np.array(behind[::-1])
        moves = np.zeros((3, 3))
        for t in range(rows - 1):
            both = np.outer(ahead[t], likely[t + 1] * behind[::-1][t + 1]) * move
            moves += both / both.sum()
        found = regime.forward_backward(likely, start, move)
        np.testing.assert_allclose(found[0], belief / belief.sum(axis=1, keepdims=True), atol=1e-12)
        np.testing.assert_allclose(found[1], moves, atol=1e-9)


def test_a_state_left_for_good_does_not_break_a_block():
    likely = np.zeros((400, 3))
    likely[:200, 0] = likely[200:, 1] = 1.0
    move = np.array([[0.99, 0.01, 0], [0, 1, 0], [0, 0, 1]])
    belief, moves = regime.forward_backward(likely, np.array([1.0, 0, 0]), move)
    assert belief[:200, 0].min() == belief[200:, 1].min() == 1.0
    np.testing.assert_allclose(moves, [[199, 1, 0], [0, 199, 0], [0, 0, 0]], atol=1e-9)


def test_each_series_has_its_own_regimes(spark):
    rng = np.random.default_rng(5)
    day = dt.date(2020, 1, 1)
    levels = {"UP": (-1, 0, 1), "DOWN": (1, 0, -1)}
    rows = [(name, day + dt.timedelta(days=i), *map(float, r)) for name, of in levels.items() for i, r in enumerate(np.concatenate([rng.normal(m, 0.1, (50, 4)) for m in of]))]
    both = spark.createDataFrame(rows + [("NEW", day, 0.0, 0.0, 0.0, 0.0)], ["ticker", "d", *regime.FEATURES]).withColumn("d", F.col("d").cast("date")).cache()
    last = {(r.ticker, r.regime) for r in regime.hmm_regime(both, 30).collect()}
    assert last == {("UP", "bull"), ("DOWN", "bear"), ("NEW", "bull")}
    models = regime.hmm_models(both).cache()
    assert sorted((r.ticker, r.fit_rows) for r in models.collect()) == [("DOWN", 63), ("DOWN", 126), ("UP", 63), ("UP", 126)]
    stored = {(r.ticker, r.regime, r.fit_rows) for r in regime.hmm_stored_regime(both, models, 20).collect()}
    assert stored == {("UP", "bull", 126), ("DOWN", "bear", 126), ("NEW", "bull", 0)}
    alone = regime.hmm_models(both.where("ticker = 'UP'")).orderBy("fit_rows").collect()
    for x, y in zip(alone, models.where("ticker = 'UP'").orderBy("fit_rows").collect(), strict=True):
        np.testing.assert_allclose(np.array(x.mean), np.array(y.mean))


def test_weights_from_a_file(spark, tmp_path):
    path = tmp_path / "weights.yaml"
    path.write_text("# weights\nanalyst:\n  buy_bonus: 25  # points\nnews:\n  sentiment_positive_threshold: 0.5\nmax_scores:\n  analyst: 30\n")
    assert context.load_weights(spark, str(path)) == context.DEFAULTS | {"buy_bonus": 25.0, "sentiment_positive": 0.5}
    assert context.load_weights(spark, str(tmp_path / "none")) == context.DEFAULTS
    path.write_text("buy_bonus: much\n")
    with pytest.raises(ValueError):
        context.load_weights(spark, str(path))


def test_a_store_in_each_mode(spark, tmp_path):
    day = dt.date(2024, 1, 30)
    rows = spark.createDataFrame([("A", day + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5 + i, 10.0) for i in range(6)], tables.BAR)
    path = str(tmp_path / "bars")
    tables.write_bars(rows.where("d < '2024-02-02'"), path)
    late = rows.where("d > '2024-01-31'")
    assert tables.brought_up(spark, path, late, "local", "2024-02-02") is None and tables.read_bars(spark, path).count() == 3
    assert tables.brought_up(spark, path, late, "local", "2024-02-07") == 3 and tables.read_bars(spark, path).count() == 6
    assert tables.brought_up(spark, path, late, "incremental", "2024-02-07") == 0
    assert tables.brought_up(spark, path, late, "force", "2024-02-07") == tables.read_bars(spark, path).count() == 4
    with pytest.raises(ValueError):
        tables.brought_up(spark, path, late, "odd", "2024-02-07")


def test_rows_in_the_order_of_a_column(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0)], "id int, x double")
    assert [r.id for r in in_order(rows, "x").collect()] == [1, 4, 3, 2]
    assert [r.id for r in in_order(rows, "x", descending=True).collect()] == [3, 1, 4, 2]


def test_hmm_is_fitted_anew_every_63_dates_and_decodes_from_its_table(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.1, (50, 4)) for m in (-1, 0, 1)])
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(x)]
    features = spark.createDataFrame(rows, ["d", *regime.FEATURES]).withColumn("d", F.col("d").cast("date"))
    models = regime.hmm_models(features).cache()
    assert sorted(r.fit_rows for r in models.collect()) == [63, 126]
    found = regime.hmm_stored_regime(features, models, 40).orderBy("d").collect()
    assert len(found) == 40 and {(r.fit_rows, r.regime) for r in found} == {(126, "bull")}
    whole = regime.hmm_regime(features.where(F.col("d") < day + dt.timedelta(days=126)), 126).orderBy("d").collect()
    again = regime.hmm_stored_regime(features.where(F.col("d") < day + dt.timedelta(days=126)), models, 126).orderBy("d").collect()
    assert [r.regime for r in whole] == [r.regime for r in again]
    assert {r.regime for r in regime.hmm_stored_regime(features, models.where("false")).collect()} == {"bull"}


def test_exits_far_from_their_entry_and_on_block_borders(spark):
    rng = np.random.default_rng(2)
    walk = 100 + rng.normal(0, 1, 400).cumsum()
    rows = [(float(c), float(c + 1), float(c - 1), float(c)) for c in walk]
    table = bars(spark, rows)
    at = [(t, float(rows[t][1] + 0.2), float(rows[t][2] - 1 - t % 9), float(rows[t][1] + 2 + t % 13)) for t in range(0, 390, 3)]
    signals = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=t), t, e, s, g) for t, e, s, g in at], "ticker string, d date, t long, entry double, stop double, target double")
    found = {r.t: (r.entry_t, None if r.outcome is None else r.entry_t + r.holding) for r in backtest.simulate(signals, table).collect()}
    for t, e, s, g in at:
        entry = next((k for k in range(t + 1, min(t + 6, 400)) if rows[k][1] >= e), None)
        exit_ = None if entry is None else next((k for k in range(entry, 400) if rows[k][2] <= s or rows[k][1] >= g), None)
        assert found[t] == ((None, None) if exit_ is None else (entry, exit_))


def test_exits_of_a_very_long_series(spark):
    """A million bars of one ticker: exits up to hundreds of thousands of bars away, through blocks of 64 and 4096."""
    n = 1_000_000
    close = 100 + 20 * np.sin(np.arange(n) / 90_000) + np.sin(np.arange(n) / 7)
    t = F.col("id")
    table = spark.range(n).select(F.lit("A").alias("ticker"), F.date_add(F.lit("1970-01-01").cast("date"), (t % 20_000).cast("int")).alias("d"), t.alias("t"), (100 + 20 * F.sin(t / 90_000) + F.sin(t / 7)).alias("close"))
    table = table.withColumns({"open": F.col("close"), "high": F.col("close") + 0.5, "low": F.col("close") - 0.5})
    rows = []
    for at in range(0, n - 10, 9_973):
        entry = float(close[at] - 5)  # fills at the next open
        rows.append(("A", dt.date(2020, 1, 1), at, entry, float(close[at] - 1.2 - at % 37), float(close[at] + 1.2 + at % 41)))
    signals = spark.createDataFrame(rows, "ticker string, d date, t long, entry double, stop double, target double")
    found = {r.t: None if r.outcome is None else r.entry_t + r.holding for r in backtest.simulate(signals, table).collect()}
    assert len(found) == len(rows)
    for _, _, at, _, stop, target in rows:
        hit = np.flatnonzero((close[at + 1 :] - 0.5 <= stop - 1e-9) | (close[at + 1 :] + 0.5 >= target + 1e-9))
        near = np.flatnonzero((close[at + 1 :] - 0.5 <= stop + 1e-9) | (close[at + 1 :] + 0.5 >= target - 1e-9))
        assert found[at] in ({None if not len(x) else at + 1 + int(x[0]) for x in (hit, near)})


def test_equity_of_accounts_over_dates(spark):
    rng = random.Random(4)
    rows = [(a, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(9)), i, round(rng.uniform(-50, 50), 2)) for a in ("x", "y") for i in range(70)]
    table = spark.createDataFrame(rows, "account string, d date, n int, pnl double").repartition(5)
    found = {(r.account, r.n): r for r in positions.equity_curve(table, ["d", "n"], 1000.0, "account").collect()}
    for a in ("x", "y"):
        value = peak = 1000.0
        for _, d, n, pnl in sorted(r for r in rows if r[0] == a):
            value += pnl
            peak = max(peak, value)
            r = found[a, n]
            assert (r.value, r.peak, r.drawdown_pct) == (pytest.approx(value), pytest.approx(peak), pytest.approx((peak - value) / peak * 100, abs=1e-9))
    assert positions.equity_curve(table.limit(0), ["d", "n"]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_a_volatile_market_runs_two_scans_at_half_size(spark):
    from tickloom.plans import signal_queries

    sf = "/root/testdata/sf0.01"
    found = signal_queries.bars_with_indicators(spark, sf)
    metrics = shared.written(signal_queries.wide_metrics(found), "metrics")
    dates = found.select("d").distinct()
    calm = signal_queries.signals(spark, sf, found, dates.withColumn("vix", F.lit(40.0)), metrics)
    wild = shared.written(signal_queries.signals(spark, sf, found, dates.withColumn("vix", F.lit(40.5)), metrics), "wild")
    assert {r.size_mult for r in calm.select("size_mult").distinct().collect()} == {1.0}
    assert {(r.strategy, r.regime, r.size_mult) for r in wild.select("strategy", "regime", "size_mult").distinct().collect()} <= {("mean_reversion", "bear", 0.5), ("pead", "bear", 0.5)}
    assert wild.count() > 0
    free = wild.withColumn("guard_reason", F.lit(None).cast("string"))
    rich = lambda rows: {(r.d, r.ticker): r.allocated_dollars for r in final.recommended(rows, 10_000.0, 1e9).collect()}
    half, whole = rich(free), rich(free.withColumn("size_mult", F.lit(1.0)))
    assert half and set(half) == set(whole)
    assert all(half[k] == pytest.approx(whole[k] / 2, abs=0.011) or whole[k] == 500.0 and half[k] <= 500.0 for k in half)


def test_beta_counts_in_a_bear_market_only(spark):
    rows = spark.createDataFrame([("bear", "Software", 0.9), ("bear", "Software", 1.0), ("bear", "Software", None), ("bear", "Utilities", 2.0), ("bull", "Software", 0.5)], "regime string, industry string, beta double")
    rows = rows.withColumns({"current_rsi": F.lit(80.0), "price": F.lit(10.0), "dma_50": F.lit(9.0)})
    assert [r[0] for r in rows.select(ranking.regime_score(F.col("beta"))).collect()] == [100.0, 0.0, 0.0, 100.0, 0.0]
    assert [r[0] for r in rows.select(ranking.regime_score()).collect()] == [0.0, 0.0, 0.0, 100.0, 0.0]


def test_buckets_spare_the_shuffle(spark):
    from pyspark.sql import Window

    rows = shared.bucketed(spark.range(500).select((F.col("id") % 7).cast("string").alias("ticker"), F.col("id").alias("t")), "rows", "ticker")
    moved = rows.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("t")))
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString() and moved.count() == 500


def test_bar_store_refresh_and_upsert(spark, tmp_path):
    day = dt.date(2024, 1, 30)
    rows = spark.createDataFrame([("A", day + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5 + i, 10.0) for i in range(6)], tables.BAR)
    path = str(tmp_path / "bars")
    tables.write_bars(rows.where("d < '2024-02-02'"), path)
    assert tables.refresh(spark, path, rows) == 3 and tables.refresh(spark, path, rows) == 0
    assert tables.read_bars(spark, path).count() == 6
    assert tables.read_bars(spark, path, "2024-01-31", "2024-02-02", end_exclusive=True).count() == 2
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 3), ("c", None)], "k string, v int")
    assert sorted(map(tuple, tables.upserted(target, changes, ["k"]).collect()), key=str) == [("a", 1), ("b", 3), ("c", None)]
    assert sorted(map(tuple, tables.updated(target, changes, ["k"]).collect())) == [("a", 1), ("b", 3)]
    tables.replace_table(spark, target, str(tmp_path / "t"))
    tables.replace_table(spark, spark.read.parquet(str(tmp_path / "t")).where("v = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    tables.export_csv(target, str(tmp_path / "csv"))
    tables.export_json(target, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2


def test_wide_bars_and_missing_columns(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 5.0, None)], "d date, `A|CLOSE` double, `A|VOLUME` double, `B|CLOSE` double")
    assert [(r.ticker, r.close, r.volume) for r in tables.wide_to_long(wide).collect()] == [("A", 1.0, 5.0)]
    with pytest.raises(ValueError, match="close"):
        tables.clean_bars(spark.createDataFrame([("A", dt.date(2024, 1, 1))], "Ticker string, Date date"))
    nan = spark.createDataFrame([("A", dt.date(2024, 1, 1), float("nan"), 1.0, 2.0)], "TICKER string, DATE date, OPEN double, CLOSE double, VOLUME double")
    assert tables.clean_bars(nan).first().open is None


def test_position_steps():
    held = (100.0, 95.0, 107.0, 112.0, 118.0, 2.0, 0, "open")
    held, event = ticks.step(held, 108.0)
    assert event == ("hit_t1", 107.0, 0.5) and held[1] == 100.0
    held, event = ticks.step(held, 108.0)
    assert event[0] == "ratchet" and held[1] == 104.0
    assert ticks.step(held, 99.0)[1] == ("stopped", 104.0, 1.0)
    assert ticks.step(held, 120.0)[1] == ("hit_t3", 118.0, 1.0)
    pending = (100.0, 95.0, 107.0, 112.0, 118.0, 2.0, 0, "pending")
    assert [ticks.step(pending, p)[0][7] for p in (102.5, 95.0, 101.0)] == ["cancelled_gap_up", "cancelled_gap_down", "open"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"T{i % 3}", dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=7 * i), 100.0 + i % 11) for i in range(60)]
    schema = "tick_id long, ticker string, ts timestamp, price double"
    frame = spark.createDataFrame([*rows, rows[3]], schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = dt.datetime(2024, 1, 3)
    spark.createDataFrame([(999, "T9", late, 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ticks.tick_bars(source).writeStream.format("memory").queryName("tick_bars").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted(map(tuple, spark.table("tick_bars").where("ticker <> 'T9'").collect()))
    assert got == sorted(map(tuple, ticks.tick_bars(frame).collect())) and len(got) > 10


# --- rank steps, final rows and stores -----------------------------------------------------------------


def signal_rows(spark):
    rows = [("csm", "A", 50.0, 12.0, None, None), ("csm", "B", 90.0, 30.0, None, None), ("csm", "C", 95.0, 40.0, None, "few trades"), ("csm", "D", 60.0, 12.0, None, None)]
    rows += [("pead", "A", 70.0, 1.0, 4, None), ("pead", "B", 70.0, 2.0, 1, None), ("pead", "C", 80.0, 2.0, 5, None), ("pead", "D", 70.0, 2.0, None, None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "strategy string, ticker string, composite_score double, returns_3m double, days_since int, guard_reason string, d int")


def test_scans_hand_on_unblocked_signals_in_their_own_order(spark):
    found = ranking.by_strategy(signal_rows(spark)).orderBy("strategy", "scan_place").collect()
    assert [(r.strategy, r.ticker) for r in found] == [("csm", "B"), ("csm", "D"), ("csm", "A"), ("pead", "C"), ("pead", "B"), ("pead", "A")]


def test_open_tickers_are_not_recommended_again(spark):
    held = spark.createDataFrame([("b", 1), ("A", 2)], "ticker string, d int")
    assert {r.ticker for r in final.without_open(signal_rows(spark), held).collect()} == {"A", "C", "D"}


def test_candidates_have_all_fields_and_defaults(spark):
    rows = spark.createDataFrame([("X", "12.5", "bad", None, 33.0, True)], "ticker string, price string, stop_loss string, target_1 double, win_rate double, is_blocked boolean")
    r = final.candidates(rows).first()
    assert len(r) == 45 and (r.ticker, r.price, r.stop_loss, r.target_1, r.past_win_rate, r.is_blocked, r.position_sizing, r.tier_label) == ("X", 12.5, 0.0, None, 33.0, False, "50/30/20", "Unrated")


def test_size_labels_name_shares(spark):
    rows = spark.createDataFrame([(1, 0.04, 100.0), (1, 0.04, 1000.0), (1, 0.0, 10.0)], "d int, fraction double, entry_price double").withColumns({"portfolio_value": F.lit(10000.0), "cash": F.lit(1e6)})
    assert sorted(r.position_sizing for r in sizing.normalised(rows, "d").collect()) == ["K: 0.0%", "K: 4.0% (0.40 sh)", "K: 4.0% (4 sh)"]


def test_a_range_prunes_months_and_a_swap_keeps_a_table(spark, tmp_path):
    day = dt.date(2000, 1, 5)
    bars = spark.createDataFrame([("A", day + dt.timedelta(days=20 * k), 1.0, 2.0, 0.5, 1.5, 9.0) for k in range(12)], tables.BAR)
    path = f"file://{tmp_path}/bars"
    tables.write_bars(bars, path)
    some = tables.read_bars(spark, path, "2000-03-01", "2000-04-30")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and {r.d.month for r in some.collect()} == {3, 4}
    tables.write_bars(bars, path)  # the same months again: replaced, not added
    assert tables.read_bars(spark, path).count() == 12
    own = f"file://{tmp_path}/table"
    tables.replace_table(spark, bars, own)
    tables.replace_table(spark, spark.read.parquet(own).limit(5), own)
    assert spark.read.parquet(own).count() == 5
    # a swap that stopped halfway is taken back before the next one
    os.rename(f"{tmp_path}/table", f"{tmp_path}/table__before")
    tables.replace_table(spark, bars, own)
    assert spark.read.parquet(own).count() == 12 and not os.path.exists(f"{tmp_path}/table__before")


def test_refresh_modes_and_quotes(spark):
    assert [tables.refresh_mode(*c, ci=ci) for c, ci in (((None, "FORCE"), True), (("odd", None), True), ((), False), (("local", "force"), True))] == ["force", "incremental", "local", "local"]
    row = spark.createDataFrame([(None, 0.0, 3.0, 4.0)], "a double, b double, c double, e double")
    assert row.select(tables.quote("a", "b", "c", "e")).first()[0] == 3.0


def test_outcomes_look_no_further_than_their_bars(spark):
    day = dt.date(2000, 1, 3)
    bars = spark.createDataFrame([("A", day + dt.timedelta(days=k), k, 10.0 + (k == 30), 9.0, 9.5) for k in range(60)], "ticker string, d date, t int, high double, low double, close double")
    signals = spark.createDataFrame([("s", "A", day + dt.timedelta(days=k), 9.4, 8.0, 10.5, 11.0, 12.0) for k in (5, 25, 55)], "strategy string, ticker string, d date, entry_price double, stop_loss double, target_1 double, target_2 double, target_3 double")
    found = {r.d: (r.outcome, r.holding) for r in positions.outcomes(signals, bars).collect()}
    assert found == {day + dt.timedelta(days=5): ("expired", 20), day + dt.timedelta(days=25): ("hit_t2", 5)}
    assert positions.outcomes(signals, bars, today=F.lit(day + dt.timedelta(days=25))).count() == 1


@pytest.mark.parametrize("busy", [0, 2, 3])
def test_provider_is_asked_again_and_then_for_single_tickers(spark, tmp_path, busy):
    from datetime import date

    from tickloom.sources import provider

    class Shaky:
        """A provider that is busy at first, fails on calls with more than one ticker where "BAD" is among them, and never has it."""

        def __init__(self, folder: str, busy: int):
            self.folder, self.busy = folder, busy

        def history(self, tickers, first, last):
            from pathlib import Path

            import pyarrow as pa

            from tickloom.sources import provider

            mark = Path(self.folder, "-".join(tickers))
            mark.mkdir(exist_ok=True)
            calls = len(os.listdir(mark)) + 1
            (mark / str(calls)).touch()
            if "BAD" in tickers:
                raise ValueError("no such ticker")
            if calls <= self.busy:
                raise provider.Throttled
            return pa.table({"ticker": tickers, "d": [first] * len(tickers), **{c: [1.0] * len(tickers) for c in ("open", "high", "low", "close", "volume")}}).cast(provider.SCHEMA)

    tickers = spark.createDataFrame([("A",), ("B",), ("BAD",), ("C",), (None,), ("A",)], "name string")
    asked = provider.fetched(tickers, Shaky(str(tmp_path), busy), date(2020, 1, 2), date(2020, 1, 9), chunk=10, calls=1, wait=0.01)
    bars = sorted(tuple(r) for r in asked.collect())
    assert bars == ([(t, date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0) for t in "ABC"] if busy < 3 else [])
    assert len(os.listdir(tmp_path / "A")) == min(busy + 1, 3) and len(os.listdir(tmp_path / "BAD")) == 1
    empty = provider.fetched(tickers.limit(0), Shaky(str(tmp_path), 0), date(2020, 1, 2), date(2020, 1, 9))
    assert empty.count() == 0 and provider.missing(tickers.where("name in ('A', 'BAD')"), empty.limit(0)).count() == 2
