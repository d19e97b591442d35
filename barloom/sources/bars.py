"""The bar adapter: one daily bar for each supplier and shipping day of lineitem, and sparse adjustment factors.

Prices follow a random walk whose steps are the day's mean discount less its centre; highs and lows are opened by the
day's taxes, volumes come from its quantities. All prices lie on a lattice of 1e-4, so that sums agree on every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import series, tie_safe
from ..stored import BUCKET, SORT, bucket_count, stored


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, symbol, trade_date, trade_year, open, high, low, close, volume, amount; built once, bucketed by instrument."""
    return stored(spark, f"{sf_dir}/lineitem.parquet", "raw_daily", lambda: build_raw_daily(spark, sf_dir))


def build_raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/lineitem.parquet"
    place = F.col("l_suppkey") % 3
    lines = spark.read.parquet(source).select(
        F.when(place == 0, "sh").when(place == 1, "sz").otherwise("bj").alias("market"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    # Dealt out once, as the stored table is: days have little more than one line each, so nothing is summed before that.
    day = lines.repartition(bucket_count(spark, source), *BUCKET).groupBy(*SORT).agg((F.avg("l_discount") - F.lit(0.05)).alias("step"), F.max("l_tax").alias("mx"), F.min("l_tax").alias("mn"), F.sum("l_quantity").alias("q"))
    walk = day.withColumn("cum", F.sum("step").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    price = lambda x: tie_safe(F.lit(100) * F.exp(F.lit(0.5) * x), 4)
    priced = walk.withColumns({"close": price(F.col("cum")), "open": price(F.col("cum") - F.col("step"))})
    return priced.select(
        "market",
        "symbol",
        "trade_date",
        F.year("trade_date").alias("trade_year"),
        "open",
        tie_safe(F.greatest("open", "close") * (1 + F.lit(0.1) * F.col("mx")), 4).alias("high"),
        tie_safe(F.least("open", "close") * (1 - F.lit(0.1) * F.col("mn")), 4).alias("low"),
        "close",
        (F.col("q") * 100000).cast("long").alias("volume"),
        F.floor(F.col("q") * 100000 * F.col("close") + F.lit(0.5)).cast("double").alias("amount"),
    )


def adjustment_factors(raw: DataFrame) -> DataFrame:
    """Sparse factors (market, symbol, trade_date, start_date, end_date, qfq_factor, hfq_factor, source): days 3 and 17 of a month."""
    d = F.dayofmonth("trade_date")
    return raw.where(d.isin(3, 17)).select(
        "market",
        "symbol",
        "trade_date",
        F.col("trade_date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        (F.lit(0.5) + (d % 10) / F.lit(10.0)).alias("qfq_factor"),
        (F.lit(1.0) + (d % 10) / F.lit(20.0)).alias("hfq_factor"),
        F.lit("adapter").alias("source"),
    )
