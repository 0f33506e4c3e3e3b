"""Queries over tick streams, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.indicator_queries import C, query
from tickloom.plans.position_queries import held
from tickloom.sources import market, shared
from tickloom.streaming import ticks as streams


def ticks(spark, sf_dir) -> DataFrame:
    """Ticks out of the events table: a ticker per user, the price around 100."""
    events = market.table(spark, sf_dir, "events")
    return events.select(C("event_id").alias("tick_id"), F.concat(F.lit("T"), (C("user_id") % 10).cast("string")).alias("ticker"), C("ts").cast("timestamp").alias("ts"), F.round(100 + C("value") % 20, 2).alias("price"))


_BARS = """SELECT ticker, time_bucket(INTERVAL 15 MINUTE, ts) AS start, arg_min(price, {'ts': ts, 'k': tick_id}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {'ts': ts, 'k': tick_id}) AS close, count(*) AS ticks
  FROM (SELECT event_id AS tick_id, 'T' || user_id % 10 AS ticker, ts, round(100 + value % 20, 2) AS price FROM events) GROUP BY 1, 2"""


@query(_BARS)
def stream_tick_bars_batch(spark, sf_dir):
    return streams.tick_bars(ticks(spark, sf_dir)).withColumn("start", C("start").cast("timestamp_ntz"))


def _position_ticks(spark, sf_dir) -> DataFrame:
    """Every position with a few ticks around its entry, in order."""
    rows = held(spark, sf_dir).where("status <> 'closed'")
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("tick_id"), F.lit(m).alias("m")) for k, m in enumerate((1.0, 1.03, 0.995, 1.09, 1.16, 0.93, 1.25)))))
    rows = rows.select("*", steps.alias("s"))
    at = F.timestamp_seconds(F.unix_seconds(C("d").cast("timestamp")) + C("s.tick_id") * 900)
    return rows.select("id", "ticker", C("s.tick_id").cast("long").alias("tick_id"), at.alias("ts"), F.round(C("entry_price") * C("s.m") + 1e-9, 2).alias("price"), "entry_price", "stop_loss", "target_1", "target_2", "target_3", (C("entry_price") * 0.02).alias("atr"), "status")


_EVENTS = """SELECT * FROM (WITH RECURSIVE tick AS (SELECT id, k, CAST(d AS TIMESTAMP) + k * INTERVAL 15 MINUTE AS ts, round(entry_price * m + 1e-9, 2) AS now
    FROM held, (VALUES (0, 1e0), (1, 1.03e0), (2, 0.995e0), (3, 1.09e0), (4, 1.16e0), (5, 0.93e0), (6, 1.25e0)) v(k, m) WHERE status <> 'closed'),
  run(id, k, entry, stop, t1, t2, t3, atr, sold1, sold2, status, ts, event, price, fraction) AS (
    SELECT id, -1, entry_price, stop_loss, target_1, target_2, target_3, entry_price * 0.02e0, false, false, status, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), 0e0, 0e0 FROM held WHERE status <> 'closed'
    UNION ALL SELECT id, k, CASE WHEN e = 'opened' THEN now ELSE entry END, CASE e WHEN 'hit_t1' THEN greatest(stop, entry) WHEN 'ratchet' THEN raised ELSE stop END, t1, t2, t3, atr,
      sold1 OR coalesce(e IN ('hit_t1', 'hit_t2'), false), sold2 OR coalesce(e = 'hit_t2', false),
      CASE WHEN e LIKE 'cancelled%' THEN e WHEN e = 'opened' THEN 'open' WHEN e IN ('hit_t3', 'stopped') THEN 'closed' ELSE status END, ts, e,
      CASE e WHEN 'hit_t3' THEN t3 WHEN 'hit_t2' THEN t2 WHEN 'hit_t1' THEN t1 WHEN 'stopped' THEN CASE WHEN t1 IS NULL THEN now ELSE stop END ELSE now END,
      CASE e WHEN 'hit_t3' THEN 1e0 WHEN 'hit_t2' THEN 0.3e0 WHEN 'hit_t1' THEN 0.5e0 WHEN 'stopped' THEN 1e0 ELSE 0e0 END
    FROM (SELECT *, CASE
        WHEN status = 'pending' THEN CASE WHEN entry > 0 AND (now / entry - 1) * 100 > 2 THEN 'cancelled_gap_up' WHEN now <= stop THEN 'cancelled_gap_down' ELSE 'opened' END
        WHEN status <> 'open' THEN NULL WHEN t1 IS NOT NULL AND now >= t3 THEN 'hit_t3' WHEN t1 IS NOT NULL AND now >= t2 AND NOT sold2 THEN 'hit_t2'
        WHEN now >= t1 AND now < t2 AND NOT sold1 THEN 'hit_t1' WHEN now <= stop THEN 'stopped' WHEN now > entry AND raised > stop THEN 'ratchet' END AS e
      FROM (SELECT r.* EXCLUDE (k, ts), tick.k, tick.ts, now, round(now - CASE WHEN atr > 0 THEN 2 * atr ELSE now * 0.02e0 END + 1e-9, 2) AS raised FROM run r JOIN tick ON tick.id = r.id AND tick.k = r.k + 1)))
  SELECT id, ts, event, price, fraction, stop AS stop_loss FROM run WHERE event IS NOT NULL)"""


@query(_EVENTS)
def stream_positions_batch(spark, sf_dir):
    return _zoneless(streams.position_events_batch(_position_ticks(spark, sf_dir)))


def _zoneless(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", C("ts").cast("timestamp_ntz"))


def _run(rows: DataFrame, plan) -> DataFrame:
    """A plan over the rows as a stream of files, to its end; state and results in the shared folder."""
    spark, source = rows.sparkSession, shared.written(rows, "ticks")
    folder = source.inputFiles()[0].rpartition("/")[0] if source.inputFiles() else None
    if folder is None:
        return plan(rows)
    stream = plan(spark.readStream.schema(rows.schema).parquet(folder))
    writer = stream.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}-out")


@query(_BARS)
def stream_tick_bars(spark, sf_dir):
    """The same bars from a stream of files, and at the end of input those of windows that the watermark has not passed."""
    rows = ticks(spark, sf_dir)
    closed = _run(rows, streams.tick_bars)
    still_open = streams.tick_bars(rows).join(closed.select("ticker", "start"), ["ticker", "start"], "left_anti")
    return closed.union(still_open.select(*closed.columns)).withColumn("start", C("start").cast("timestamp_ntz"))


@query(_EVENTS)
def stream_positions(spark, sf_dir):
    """Position events from a stream with state per position."""
    return _zoneless(_run(_position_ticks(spark, sf_dir), streams.position_events))
