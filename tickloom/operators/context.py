"""Context scores from analysts, earnings, fundamentals and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
#: Thresholds and bonuses; ``with_weights`` replaces any of them.
DEFAULTS = {
    "upside_threshold_bonus": 0.05, "buy_bonus": 10, "surprise_beat_big": 5, "surprise_beat_small": 0, "surprise_miss_big": -5,
    "debt_to_equity_max": 1.0, "current_ratio_min": 1.5, "sentiment_positive": 0.2, "sentiment_negative": -0.2,
}


def with_weights(**changed: float) -> dict[str, float]:
    unknown = set(changed) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown context weights: {sorted(unknown)}")
    return DEFAULTS | changed


def load_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Weights from a file of ``name: number`` lines under section names, on any path that Spark reads; the defaults for what it lacks, or where there is no file.

    Sections, comments and names that no rule uses are passed over; a known name without a number is an error.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return dict(DEFAULTS)
    changed = {}
    for (line,) in spark.read.text(path).collect():  # a settings file
        name, _, value = line.partition("#")[0].partition(":")
        if (name := name.strip().removesuffix("_threshold")) in DEFAULTS:
            changed[name] = float(value)
    return with_weights(**changed)


def parts(w: dict[str, float] = DEFAULTS) -> dict[str, Column]:
    """Points by source; a missing figure gives none."""
    upside = (C("target_mean_price") - C("price")) / C("price")
    has_target = C("target_mean_price").isNotNull() & (C("target_mean_price") != 0) & (C("price") > 0)
    target = F.when(has_target & (upside > w["upside_threshold_bonus"]), 30).when(has_target & (upside > 0), 15).otherwise(0)
    advice = F.when(has_target & C("recommendation").isin("buy", "strong_buy"), w["buy_bonus"]).otherwise(0)
    s, news = C("surprise_percent"), C("sentiment")
    return {
        "analyst": (target + advice).cast("double"),
        "earnings": F.when(s > w["surprise_beat_big"], 30.0).when(s > w["surprise_beat_small"], 15.0).when(s < w["surprise_miss_big"], -15.0).otherwise(0.0),
        "fundamental": F.when(C("debt_to_equity") < w["debt_to_equity_max"], 10.0).otherwise(0.0) + F.when(C("current_ratio") > w["current_ratio_min"], 10.0).otherwise(0.0),
        "news": F.when(news > w["sentiment_positive"], F.least(F.lit(20.0), news * 50)).when(news < w["sentiment_negative"], -10.0).otherwise(0.0),
        "event": F.when(C("event") > 0, F.least(F.lit(15.0), C("event") * 10)).otherwise(0.0),
    }


def scored(rows: DataFrame, w: dict[str, float] = DEFAULTS) -> DataFrame:
    """``context_score`` from 0 to 100 and its parts; a score of 0 falls back on a technical heuristic of at most 15."""
    rows = rows.withColumns({f"{n}_pts": c for n, c in parts(w).items()})
    total = C("analyst_pts") + C("earnings_pts") + C("fundamental_pts") + C("news_pts") + C("event_pts")
    technical = F.greatest(F.lit(0.0), (C("rsi_14") - 30) / 70) * 5 + F.greatest(F.lit(0.0), (C("adx_14") - 10) / 40) * 5 + F.greatest(F.lit(0.0), (C("volume_ratio") - 0.5) * 10)
    rows = rows.withColumn("_total", F.when(total == 0, F.least(F.lit(15.0), technical)).otherwise(total))
    rows = rows.withColumns({"context_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), C("_total"))), "analyst_pts": F.least(C("analyst_pts"), F.lit(40.0))})
    return rows.drop("_total")


def surprise(actual: Column, estimate: Column, vendor: Column) -> Column:
    """The vendor's figure, else the actual's distance from the estimate in percent (0 for an estimate of 0)."""
    own = F.when(estimate == 0, 0.0).otherwise((actual - estimate) / F.abs(estimate) * 100)
    return F.round(F.coalesce(vendor, own), 2)


def sentiment(news: DataFrame, most: int = 10) -> DataFrame:
    """Mean signed sentiment of each ticker's first ``most`` headlines."""
    first = news.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("doc_id"))).where(C("_n") <= most)
    signed = F.when(C("label") == "positive", C("strength")).when(C("label") == "negative", -C("strength")).otherwise(0.0)
    return first.groupBy("ticker").agg(F.avg(signed).alias("sentiment"), F.count("*").alias("articles"))
