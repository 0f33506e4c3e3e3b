"""The life of a position: pending gate, nightly evaluation, outcomes, splits, exits by lots, equity, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import calendar, joins

C = F.col
START_VALUE = 10000.0
TIE = 1e-9  # ties round up, however the product came out in its last bits
#: Reason texts by outcome.
REASONS = {"stopped": "Stop loss hit", "hit_t3": "Target 3 hit – full exit", "hit_t2": "Target 2 hit – sell 30%", "hit_t1": "Target 1 hit – sell 50%"}
FRACTIONS = {"stopped": 1.0, "hit_t3": 1.0, "hit_t2": 0.3, "hit_t1": 0.5, "closed": 1.0}


def _mapped(outcome: Column, values: dict, otherwise=None) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(outcome == key, value) if out is None else out.when(outcome == key, value)
    return out.otherwise(otherwise)


def pending_gate(pending: DataFrame, opens: DataFrame) -> DataFrame:
    """Pending positions against their first open: cancelled over a gap, or opened at the open."""
    rows = pending.join(opens.select("ticker", C("open").alias("first_open")), "ticker")
    gap = F.when(C("entry_price") > 0, (C("first_open") / C("entry_price") - 1) * 100).otherwise(0.0)
    status = F.when(gap > 2, "cancelled_gap_up").when(C("first_open") <= C("stop_loss"), "cancelled_gap_down").otherwise("open")
    rows = rows.withColumns({"gap_pct": F.round(gap + TIE, 4), "status": status})
    return rows.withColumn("entry_price", F.when(C("status") == "open", C("first_open")).otherwise(C("entry_price"))).drop("first_open")


def nightly(positions: DataFrame, last: DataFrame) -> DataFrame:
    """Open positions against their last bar: stop first, then targets 3 to 1 (each lot once), else a ratcheting stop."""
    rows = positions.where("status = 'open'").join(last.select("ticker", "close", "high", "low", "atr"), "ticker")
    told = F.coalesce(C("sell_signal_reason"), F.lit(""))
    outcome = (
        F.when(C("low") <= C("stop_loss"), "stopped")
        .when(C("high") >= C("target_3"), "hit_t3")
        .when(C("high") >= C("target_2"), F.when(~told.contains("Target 2"), "hit_t2"))
        .when(C("high") >= C("target_1"), F.when(~told.contains("Target 1"), "hit_t1"))
    )
    rows = rows.withColumn("outcome", outcome)
    price = F.when(C("outcome") == "stopped", F.least("stop_loss", "low")).otherwise(_mapped(C("outcome"), {f"hit_t{k}": C(f"target_{k}") for k in (3, 2, 1)}))
    raised = F.round(F.greatest(C("stop_loss"), C("close") - 2.0 * C("atr")), 2)
    return rows.withColumns({
        "exit_price": price, "fraction": _mapped(C("outcome"), FRACTIONS), "reason": _mapped(C("outcome"), REASONS), "price": C("close"),
        "stop_loss": F.when(C("outcome").isNull() & (raised > C("stop_loss")), raised).otherwise(C("stop_loss")),
    })


def outcomes(signals: DataFrame, bars: DataFrame, most: int = 20, today: Column | None = None, age: int = 10) -> DataFrame:
    """The validator's outcome of past signals: per later bar the stop, then targets 3 to 1, and expiry at the ``most``-th bar's close.

    With ``today``, only signals at least ``age`` business days old are judged.
    Bars are numbered by ticker (``t``), and a signal meets the ``most`` bars after
    its own through blocks of as many bars, so a long series costs no more pairs.
    """
    signals = signals.where("target_1 is not null")
    if today is not None:
        signals = signals.where(C("d") <= calendar.business_days_ago(today, age))
    later = bars.select("ticker", C("t").alias("bt"), C("d").alias("bd"), "high", "low", "close", F.floor(C("t") / most).alias("_block"))
    rows = joins.as_of(signals, bars.select("ticker", C("d").alias("_on"), C("t").alias("_at")), "ticker", "d", "_on", ["_at"]).withColumn("_at", F.coalesce("_at", F.lit(-1)))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor((C("_at") + 1) / most), F.floor((C("_at") + most) / most))))
    rows = rows.join(later, ["ticker", "_block"]).where(C("bt").between(C("_at") + 1, C("_at") + most)).withColumn("holding", (C("bt") - C("_at")).cast("int"))
    hit = F.when(C("low") <= C("stop_loss"), "stopped").when(C("high") >= C("target_3"), "hit_t3").when(C("high") >= C("target_2"), "hit_t2").when(C("high") >= C("target_1"), "hit_t1").when(C("holding") >= most, "expired")
    rows = rows.withColumn("outcome", hit).where("outcome is not null")
    price = _mapped(C("outcome"), {"stopped": C("stop_loss"), "hit_t3": C("target_3"), "hit_t2": C("target_2"), "hit_t1": C("target_1")}, C("close"))
    first = rows.withColumn("exit_price", price).groupBy("strategy", "ticker", "d", "entry_price").agg(F.min(F.struct("holding", "outcome", "exit_price", "bd")).alias("x"))
    out = first.select("strategy", "ticker", "d", "x.outcome", "x.holding", C("x.bd").alias("outcome_date"), F.round((C("x.exit_price") / C("entry_price") - 1) * 100, 4).alias("return_pct"))
    return out


def split_adjusted(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices divided and shares multiplied by the day's split ratio; a tag keeps a split from being applied twice."""
    rows = positions.join(splits.select("ticker", "split_date", "ratio"), "ticker", "left")
    tag = F.concat(F.lit("[SPLIT "), C("split_date").cast("string"), F.lit("]"))
    due = F.coalesce((C("ratio") > 0) & (C("ratio") != 1) & ~F.coalesce(C("narrative"), F.lit("")).contains(tag), F.lit(False))
    prices = {c: F.when(due, F.round(C(c) / C("ratio") + TIE, 2)).otherwise(C(c)) for c in ("entry_price", "stop_loss", "target_1", "target_2", "target_3")}
    more = {"max_shares": F.when(due, F.round(C("max_shares") * C("ratio") + TIE, 4)).otherwise(C("max_shares")), "narrative": F.when(due, F.concat_ws(" ", "narrative", tag)).otherwise(C("narrative"))}
    return rows.withColumns(prices | more).drop("split_date", "ratio")


def exit_lots(positions: DataFrame, exits: DataFrame, history: DataFrame, today: Column, stop_to_entry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply exits (``id, exit_price, outcome, reason, fraction``): the changed positions and the closed lots.

    A partial lot goes into the history under ``TICKER-T1``; a lot that is there
    already is skipped.  Exits of positions that are not open, fractions outside
    (0, 1] and exits of no shares are left out.
    """
    whole = C("fraction") == 1
    rows = positions.where("status = 'open'").join(exits, "id").where("fraction > 0 and fraction <= 1")
    sold = F.when(whole, F.coalesce("max_shares", F.lit(0.0))).otherwise(F.round(F.coalesce("max_shares", F.lit(0.0)) * C("fraction") + TIE, 4))
    dollars = F.when(whole, F.coalesce("allocated_dollars", F.lit(0.0))).otherwise(F.round(F.coalesce("allocated_dollars", F.lit(0.0)) * C("fraction") + TIE, 2))
    lot = F.when(whole, C("ticker")).otherwise(F.left(F.concat("ticker", F.lit("-"), F.upper(F.replace("outcome", F.lit("hit_"), F.lit("")))), F.lit(30)))
    rows = rows.withColumns({"shares_sold": sold, "dollars_sold": dollars, "history_ticker": lot}).where("shares_sold > 0")
    known = history.select(C("d").alias("_d"), C("ticker").alias("_ticker"), C("outcome").alias("_outcome")).distinct()
    same = (C("d") == C("_d")) & (C("history_ticker") == C("_ticker")) & (C("outcome") == C("_outcome")) & (C("fraction") < 1)
    rows = rows.join(known, same, "left_anti")
    gain = (C("exit_price") - C("entry_price")) * C("shares_sold")
    pct = F.when(C("entry_price") > 0, (C("exit_price") - C("entry_price")) / C("entry_price") * 100).otherwise(0.0)
    lots = rows.select("id", "d", C("history_ticker").alias("ticker"), "outcome", "exit_price", "shares_sold", "dollars_sold", F.round(gain, 4).alias("pnl"), F.round(pct, 4).alias("return_pct"),
                       F.greatest(F.lit(0), F.datediff(today, "d")).alias("holding_days"))
    changed = rows.select(
        "id", C("ticker"), F.when(whole, "closed").otherwise("open").alias("status"),
        F.when(whole, C("max_shares")).otherwise(F.round(C("max_shares") - C("shares_sold"), 4)).alias("max_shares"),
        F.when(whole, C("allocated_dollars")).otherwise(F.round(C("allocated_dollars") - C("dollars_sold"), 2)).alias("allocated_dollars"),
        (F.when(~whole, C("entry_price")).otherwise(C("stop_loss")) if stop_to_entry else C("stop_loss")).alias("stop_loss"),
        C("reason").alias("sell_signal_reason"), C("exit_price").alias("sell_price"),
    )
    return changed, lots


def equity_curve(pnl: DataFrame, order: list[str], start: float = START_VALUE, *account: str) -> DataFrame:
    """Value, peak and drawdown after each gain or loss of an account.

    ``order`` begins with the date.  Sums and their peaks are taken inside each
    date, in parallel, then over one row per account and date, and put together;
    so an account's ledger never goes through one task.
    """
    day, inside = order[0], [*account, order[0]]
    upto = Window.partitionBy(*inside).orderBy(*(order[1:] or order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = pnl.withColumn("_sum", F.sum("pnl").over(upto)).withColumn("_top", F.max("_sum").over(upto))
    earlier = Window.partitionBy(*(account or (F.lit(0),))).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = pnl.groupBy(*inside).agg(F.sum("pnl").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    tops = rows.groupBy(*inside).agg(F.max("_top").alias("_most"))
    days = days.join(tops, inside).withColumn("_highest", F.max(C("_before") + C("_most")).over(earlier)).select(*inside, "_before", "_highest")
    rows = rows.join(days, inside).withColumn("value", C("_before") + C("_sum") + start)
    rows = rows.withColumn("peak", F.greatest(F.lit(start), C("_highest") + start, C("_before") + C("_top") + start)).drop("_sum", "_top", "_before", "_highest")
    return rows.withColumn("drawdown_pct", F.when(C("peak") > 0, (C("peak") - C("value")) / C("peak") * 100).otherwise(0.0))


def rotation(candidates: DataFrame, holdings: DataFrame, needed: Column, cash: Column) -> DataFrame:
    """Weak holdings closed for strong candidates of the same date, in one plan.

    The k-th strongest candidate (85 or more, in order) meets the k-th weakest
    holding (55 or less).  A pair is used while the cash that earlier pairs freed
    does not cover what is needed, and the run ends at the first spread under 30,
    as a sequence of candidates against one and the same weakest holding would
    only see smaller spreads.
    """
    first = Window.partitionBy("d")
    strong = candidates.where("composite_score >= 85").withColumn("k", F.row_number().over(first.orderBy(F.desc("composite_score"), "ticker")))
    weak = holdings.where("composite_score <= 55").withColumn("k", F.row_number().over(first.orderBy("composite_score", "ticker")))
    weak = weak.select("d", "k", C("ticker").alias("weak_ticker"), C("composite_score").alias("weak_score"), "allocated_dollars")
    pairs = strong.select("d", "k", "ticker", "composite_score").join(weak, ["d", "k"]).withColumn("spread", C("composite_score") - C("weak_score"))
    up_to = first.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum("allocated_dollars").over(up_to), F.lit(0.0))
    fits = F.min(F.when(C("spread") >= 30, 1).otherwise(0)).over(first.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumns({"_freed": freed, "_fits": fits}).where((C("_fits") == 1) & (needed > cash + C("_freed"))).drop("_freed", "_fits")


def ratchet(low: Column, stop: Column, price: Column, entry: Column, atr: Column) -> Column:
    """The intraday stop: raised to two ATRs (or 2 %) under a price over the entry, never lowered."""
    step = F.when(atr > 0, 2 * atr).otherwise(price * 0.02)
    return F.when((price > entry) & (F.round(price - step, 2) > stop), F.round(price - step, 2)).otherwise(stop)


def recommendations(signals: DataFrame, history: DataFrame, metrics: DataFrame) -> DataFrame:
    """Open signals and closed history with backtest metrics."""
    shared = ("d", "ticker", "strategy", "entry_price", "stop_loss", "target_1", "target_2", "target_3", "composite_score")
    live = signals.where("status = 'open'").select(*shared, "status", C("sell_signal_reason"), F.lit(None).cast("double").alias("sell_price"), C("d").alias("entry_date"), F.lit(None).cast("date").alias("exit_date"))
    status = F.when(C("outcome").isin("stopped", "stop_loss", "hit_t3", "hit_t2", "hit_t1", "closed"), "closed").otherwise(C("outcome"))
    closed = history.where("outcome <> 'open'").select(*shared, status.alias("status"), _mapped(C("outcome"), REASONS, "Closed").alias("sell_signal_reason"), C("exit_price").alias("sell_price"), C("d").alias("entry_date"), C("outcome_date").alias("exit_date"))
    both = live.unionByName(closed).join(metrics, "ticker", "left")
    zero = {c: F.coalesce(C(c), F.lit(0)) for c in ("wins", "losses")} | {c: F.coalesce(C(c), F.lit(0.0)) for c in ("win_rate", "expectancy_pct")}
    return both.withColumns(zero).withColumn("total_trades", C("wins") + C("losses"))


def as_json(*columns: str) -> Column:
    """Columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))
