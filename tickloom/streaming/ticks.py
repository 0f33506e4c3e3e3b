"""Streams of ticks: bars per quarter hour, and positions as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def tick_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Open, high, low, close and count of each ticker and window; works on batches and streams.

    ``ticks(tick_id, ticker, ts, price)``; on a stream repeated ids within the
    watermark count once, and ticks later than the watermark are left out.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tick_id"])
    else:
        ticks = ticks.dropDuplicates(["tick_id"])
    order = F.struct("ts", "tick_id")
    bars = ticks.groupBy("ticker", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks"))
    return bars.select("ticker", C("window.start").alias("start"), "open", "high", "low", "close", "ticks")


EVENT = "id string, ts timestamp, event string, price double, fraction double, stop_loss double"
_STATE = "entry double, stop double, t1 double, t2 double, t3 double, atr double, taken int, status string"


def step(state: tuple, price: float) -> tuple[tuple, tuple | None]:
    """One price against a position: the new state, and the event (name, price, fraction) if there is one.

    Targets come before the stop: the third closes, the second sells 30 %, the
    first sells half and moves the stop to the entry, each lot once.  A stop
    fills at the stop.  Without targets the stop fills at the live price.  A
    price over the entry raises the stop to two ATRs (or 2 %) under it.
    """
    entry, stop, t1, t2, t3, atr, taken, status = state
    if status == "pending":
        if entry > 0 and (price / entry - 1) * 100 > 2:
            return (entry, stop, t1, t2, t3, atr, taken, "cancelled_gap_up"), ("cancelled_gap_up", price, 0.0)
        if price <= stop:
            return (entry, stop, t1, t2, t3, atr, taken, "cancelled_gap_down"), ("cancelled_gap_down", price, 0.0)
        return (price, stop, t1, t2, t3, atr, taken, "open"), ("opened", price, 0.0)
    if status != "open":
        return state, None
    has_targets = pd.notna(t1)
    if has_targets and price >= t3:
        return (entry, stop, t1, t2, t3, atr, taken, "closed"), ("hit_t3", t3, 1.0)
    if has_targets and price >= t2 and not taken & 2:
        return (entry, stop, t1, t2, t3, atr, taken | 3, status), ("hit_t2", t2, 0.3)
    if has_targets and t1 <= price < t2 and not taken & 1:
        return (entry, max(stop, entry), t1, t2, t3, atr, taken | 1, status), ("hit_t1", t1, 0.5)
    if price <= stop:
        return (entry, stop, t1, t2, t3, atr, taken, "closed"), ("stopped", stop if has_targets else price, 1.0)
    if price > entry:
        raised = round(price - (2 * atr if pd.notna(atr) and atr > 0 else price * 0.02) + 1e-9, 2)  # ties up, as everywhere
        if raised > stop:
            return (entry, raised, t1, t2, t3, atr, taken, status), ("ratchet", price, 0.0)
    return state, None


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    rows, out = pd.concat(list(frames)).sort_values(["ts", "tick_id"]), []
    for r in rows.itertuples():
        if held is None:
            held = (r.entry_price, r.stop_loss, r.target_1, r.target_2, r.target_3, r.atr, 0, r.status)
        held, event = step(held, r.price)
        if event:
            out.append((key[0], r.ts, event[0], event[1], event[2], held[1]))
    if held is not None:
        state.update(tuple(held))
    yield pd.DataFrame(out, columns=["id", "ts", "event", "price", "fraction", "stop_loss"])


def position_events(ticks: DataFrame) -> DataFrame:
    """Events of positions as their ticks arrive: ``id, ts, event, price, fraction, stop_loss``.

    ``ticks`` has the tick (tick_id, ts, price) and its position's columns (id,
    entry_price, stop_loss, target_1 to target_3, atr, status), as a stream
    joined with the table of positions gives them.  State is kept per position.
    """
    return ticks.groupBy("id").applyInPandasWithState(_advance, EVENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def position_events_batch(ticks: DataFrame) -> DataFrame:
    """The same events from a whole table of ticks: one ordered fold per position."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        for r in rows.sort_values(["ts", "tick_id"]).itertuples():
            if held is None:
                held = (r.entry_price, r.stop_loss, r.target_1, r.target_2, r.target_3, r.atr, 0, r.status)
            held, event = step(held, r.price)
            if event:
                out.append((key[0], r.ts, event[0], event[1], event[2], held[1]))
        return pd.DataFrame(out, columns=["id", "ts", "event", "price", "fraction", "stop_loss"])

    return ticks.groupBy("id").applyInPandas(fold, EVENT)
