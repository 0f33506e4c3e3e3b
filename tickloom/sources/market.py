"""Market tables derived from the star-schema test tables.

The engine works on ``bars(ticker, d, open, high, low, close, volume, t)``; this
adapter makes deterministic bars and side tables out of ``lineitem``, ``part``
and ``documents`` so that every plan can run on them.  A ticker is a brand, a bar
a week, and the close a random walk of weekly mean discounts.  Sums are taken
over integers and prices rounded, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import by_ticker

BASE_PRICE = 100.0
INDUSTRIES = ("Semiconductors", "Utilities", "Biotech", "Health Care Services", "Software")

#: Sector funds (fixed values).
SECTOR_FUNDS = (
    ("XLK", "Technology"), ("XLF", "Financials"), ("XLE", "Energy"), ("XLI", "Industrials"), ("XLP", "Consumer Staples"), ("XLU", "Utilities"), ("XLV", "Health Care"), ("XLY", "Consumer Discretionary"),
    ("XLB", "Materials"), ("XLRE", "Real Estate"), ("XBI", "Biotech"), ("SOXX", "Semiconductors"), ("KRE", "Regional Banks"), ("SMH", "Semiconductors"), ("IBB", "Biotech"),
)


def sector_funds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SECTOR_FUNDS), "ticker string, sector string")


def fund_members(spark: SparkSession, universe: DataFrame) -> DataFrame:
    """``ticker, sector, members``: each sector fund with how many tickers of the universe are of its sector."""
    sizes = universe.groupBy(F.col("industry").alias("sector")).agg(F.count("*").alias("members"))
    return sector_funds(spark).join(sizes, "sector", "left").select("ticker", "sector", F.coalesce("members", F.lit(0)).alias("members"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> F.Column:
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of every ticker; ``t`` numbers them from 0."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    weeks = (
        sold.join(brand, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"))
        .agg(
            ((_cents("l_discount") * 1e0 / F.count("*") - 5e0) / 1e2).alias("r"),
            (_cents("l_tax") * 1e0 / F.count("*") / 1e2).alias("tx"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    path = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    walk = weeks.withColumn("close", F.lit(BASE_PRICE) * F.exp(F.sum("r").over(path)))
    walk = walk.withColumn("open", F.coalesce(F.lag("close").over(by_ticker()), F.lit(BASE_PRICE)))
    return walk.select(
        "ticker", "d",
        F.round("open", 4).alias("open"),
        F.round(F.greatest("open", "close") * (1 + F.col("tx") / 4), 4).alias("high"),
        F.round(F.least("open", "close") * (1 - F.col("tx") / 4), 4).alias("low"),
        F.round("close", 4).alias("close"),
        "volume",
        (F.row_number().over(by_ticker()) - 1).cast("long").alias("t"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, n, company_name, industry, is_etf``; a small table (one row per ticker)."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    named = brands.withColumn("n", (F.row_number().over(Window.orderBy("ticker")) - 1).cast("int"))
    industry = F.element_at(F.array(*(F.lit(i) for i in INDUSTRIES)), F.col("n") % len(INDUSTRIES) + 1)
    return named.select("ticker", "n", F.concat("ticker", F.lit(" Corp")).alias("company_name"), industry.alias("industry"), (F.col("n") % 3 == 0).alias("is_etf"))


def index_bars(bars: DataFrame, series: str | None = None) -> DataFrame:
    """The equal-weight index: ``ticker, d, close, t`` with one bar per date; or one index for each value of a column."""
    mean = F.sum(F.round(F.col("close") * 10000).cast("long")) * 1e0 / F.count("*") / 1e4
    name = F.col(series) if series else F.lit("INDEX")
    by_date = bars.groupBy(name.alias("ticker"), "d").agg(F.round(mean, 4).alias("close"))
    return by_date.select("ticker", "d", "close", (F.row_number().over(by_ticker()) - 1).cast("long").alias("t"))


def volatility_index(index: DataFrame) -> DataFrame:
    """``d, vix``: annualised deviation of the index's last 20 log returns, in percent."""
    log_return = F.log(F.col("close") / F.lag("close").over(by_ticker()))
    moved = index.withColumn("lr", log_return)
    deviation = F.stddev_samp("lr").over(by_ticker().rowsBetween(-19, 0)) * F.sqrt(F.lit(252e0)) * 100
    return moved.select("d", F.when(F.col("t") >= 20, F.round(deviation, 4)).alias("vix"))


def earnings(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Reports a few days before every 13th bar and before jumps: ``ticker, earnings_date, actual, estimate, surprise``."""
    jump = F.coalesce(F.col("close") / F.lag("close").over(by_ticker()) - 1 >= 0.02, F.lit(False))
    named = bars.withColumn("_jump", jump).where((F.col("t") % 13 == 5) | F.col("_jump")).join(universe.select("ticker", "n"), "ticker")
    return named.select(
        "ticker",
        F.date_sub("d", (1 + F.col("n") % 5).cast("int")).alias("earnings_date"),
        F.round(1 + F.col("t") % 7 * 0.1, 2).alias("actual"),
        F.round(F.col("t") % 5 * 0.1, 2).alias("estimate"),
        F.when(F.col("t") % 26 == 5, F.round((F.col("t") % 11) * 1.5 - 6, 2)).alias("surprise"),
    )


def betas(universe: DataFrame) -> DataFrame:
    """``ticker, beta`` as a data vendor gives them, with gaps."""
    n = F.col("n")
    return universe.select("ticker", F.when(n % 4 > 0, F.round(0.7 + n % 5 * 0.15, 2)).alias("beta"))


def news(spark: SparkSession, sf_dir: str, universe: DataFrame) -> DataFrame:
    """Headlines by ticker with a sentiment label and strength: ``ticker, doc_id, label, strength``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    many = universe.count()
    placed = docs.withColumn("n", (F.col("doc_id") % F.lit(max(1, many))).cast("int")).join(universe.select("ticker", "n"), "n")
    label = F.when(F.col("n_chars") % 3 == 0, "positive").when(F.col("n_chars") % 3 == 1, "negative").otherwise("neutral")
    return placed.select("ticker", "doc_id", label.alias("label"), (F.col("n_chars") % 97 / 97e0).alias("strength"))


def fundamentals(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Analyst and balance-sheet figures of each ticker, with gaps."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "d").alias("price"))
    n = F.col("n")
    return last.join(universe, "ticker").select(
        "ticker", "price",
        F.when(n % 6 != 0, F.round(F.col("price") * (0.9 + n % 5 * 0.1), 2)).alias("target_mean_price"),
        F.when(n % 3 == 0, "buy").when(n % 3 == 1, "hold").otherwise("strong_buy").alias("recommendation"),
        (n % 9).alias("num_analysts"),
        F.when(n % 7 != 0, n % 4 * 0.5).alias("debt_to_equity"),
        F.when(n % 8 != 0, 1 + n % 5 * 0.25).alias("current_ratio"),
    )
