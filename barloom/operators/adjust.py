"""As-of price adjustment: every bar takes the last factor that began on or before its day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series


def adjust(raw: DataFrame, factors: DataFrame, factor: str = "qfq_factor") -> DataFrame:
    """adj_open..adj_close, volume, amount, adj_factor for each bar of raw.

    Factors and bars are interleaved in one sort of (market, symbol, day): the last factor before a bar is a running
    `last`, so a series needs neither a range join nor more than one shuffle; none where bars and factors lie in the same
    buckets. A factor begins at start_date, else at trade_date; without either it is dropped; a null factor counts as 1.
    Without a factor a bar stays as it is. Volume is divided by the factor, half up; amount stays.
    """
    f = factors.select("market", "symbol", F.coalesce("start_date", "trade_date").alias("trade_date"), F.coalesce(factor, F.lit(1.0)).alias("f")).where("trade_date is not null")
    # A union keeps its sides' buckets only where their columns carry no table's name, so both sides rename them.
    renamed = {"market": "of_market", "symbol": "of_symbol"}
    both = raw.withColumns({"f": F.lit(None).cast("double"), "bar": F.lit(1)}).withColumnsRenamed(renamed).unionByName(f.withColumn("bar", F.lit(0)).withColumnsRenamed(renamed), allowMissingColumns=True)
    both = both.withColumnsRenamed({v: n for n, v in renamed.items()})
    w = series().orderBy("trade_date", "bar").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("known", F.last("f", ignorenulls=True).over(w)).where("bar = 1")
    k = F.coalesce("known", F.lit(1.0))
    return seen.select(
        "market",
        "symbol",
        "trade_date",
        "trade_year",
        *[(F.col(c) * k).alias(f"adj_{c}") for c in ("open", "high", "low", "close")],
        F.when(F.coalesce("known", F.lit(0.0)) == 0, F.col("volume")).otherwise(F.floor(F.try_divide(F.col("volume"), k) + F.lit(0.5)).cast("long")).alias("volume"),
        "amount",
        k.alias("adj_factor"),
    )
