"""Position sizes, stops and allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import percent_up, steps

C = F.col
CAP = 0.05  # of the portfolio per position


def win_probability(score: Column) -> Column:
    return steps(score, [(90, 0.75), (80, 0.68), (70, 0.60), (60, 0.52), (50, 0.45)], F.lit(0.35))


def half_kelly(score: Column, rr: Column) -> Column:
    """Half the Kelly fraction, at least 0; a missing risk-reward counts as 2."""
    p, rr = win_probability(score), F.when(rr > 0, rr).otherwise(2.0)
    return F.greatest(F.lit(0.0), (p - (1 - p) / rr) / 2)


def normalised(signals: DataFrame, *group: str) -> DataFrame:
    """Dollars and shares of each group's signals: capped, and scaled down together where cash is short.

    ``signals`` has fraction, entry_price, portfolio_value and cash.
    """
    wanted = F.least(C("portfolio_value") * C("fraction"), C("portfolio_value") * CAP)
    rows = signals.withColumn("wanted", wanted)
    needed = F.sum("wanted").over(Window.partitionBy(*group))
    scale = F.when(needed > C("cash"), F.greatest(C("cash"), F.lit(0.0)) / needed).otherwise(1.0)
    rows = rows.withColumn("allocated_dollars", F.round(C("wanted") * scale, 2))
    shares = F.when(C("entry_price") > 0, F.round(C("allocated_dollars") / C("entry_price"), 4)).otherwise(0.0)
    share = F.when(C("portfolio_value") > 0, C("allocated_dollars") / C("portfolio_value") * 100).otherwise(0.0)
    rows = rows.withColumns({"max_shares": shares, "whole_shares": F.floor(shares), "pct": F.round(share + 1e-9, 1)})
    held = F.when(C("max_shares") < 1, F.format_string("%.2f", F.round(C("max_shares") + 1e-9, 2))).otherwise(C("whole_shares").cast("string"))
    suffix = F.when(C("max_shares") > 0, F.concat(F.lit(" ("), held, F.lit(" sh)"))).otherwise("")
    return rows.withColumn("position_sizing", F.concat(F.lit("K: "), F.format_string("%.1f", "pct"), F.lit("%"), suffix))


def ceiling(signals: DataFrame) -> DataFrame:
    """Stops at most 7 % under the entry; targets that are not over the entry are set anew, by ATR where there is one."""
    stop = F.greatest(C("stop_loss"), F.round(C("entry_price") * 0.93, 2))
    rows = signals.withColumn("stop_loss", stop)
    bad = C("target_1") <= C("entry_price")
    anew = {f"target_{k}": F.when(bad, F.when(C("atr") > 0, F.round(C("entry_price") + m * C("atr"), 2)).otherwise(percent_up(C("entry_price"), p))).otherwise(C(f"target_{k}")) for k, m, p in ((1, 1.5, 7), (2, 2.5, 12), (3, 3.5, 18))}
    return rows.withColumns(anew)


def parsed_percent(label: Column) -> Column:
    """The percentage in a sizing label, at most 5: 5 where it is missing, unreadable or a split like 50/30/20."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"Kelly:|K:|%", ""), r"\(.*\)", ""))
    return F.when(text.contains("/"), 5.0).otherwise(F.coalesce(F.least(text.try_cast("double"), F.lit(5.0)), F.lit(5.0)))


def parsed_shares(label: Column) -> Column:
    return F.regexp_extract(F.coalesce(label, F.lit("")), r"\(([\d.]+)\s*sh\)", 1).try_cast("double")


def allocated(positions: DataFrame, portfolio_value: float) -> DataFrame:
    """Dollars that open positions occupy: their own figure, else the label's share of the portfolio."""
    own = F.when(C("allocated_dollars") > 0, C("allocated_dollars"))
    return positions.where("status = 'open'").agg(F.coalesce(F.sum(F.coalesce(own, parsed_percent(C("position_sizing")) / 100 * portfolio_value)), F.lit(0.0)).alias("allocated"))
