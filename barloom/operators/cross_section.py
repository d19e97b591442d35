"""Ranks and relative strength over all instruments of a day, and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def cross_section(f: DataFrame) -> DataFrame:
    """The day's ranks, percentile ranks, relative strength, new highs and risk of factor rows f."""
    day = Window.partitionBy("trade_date")
    k = F.col

    def place(c: str, down: bool) -> Column:
        first = k(c).desc_nulls_last() if down else k(c).asc_nulls_last()
        return F.rank().over(day.orderBy(first, "market", "symbol")).cast("long")

    x = f.withColumns({"rank_ret_20": place("ret_20", True), "rank_ret_60": place("ret_60", True), "rank_amount": place("amount_ma20", True), "rank_vol": place("vol_20", False), "rank_atr": place("atr_pct_14", False), "trade_day_count": F.count("*").over(day), "avg_ret_20": F.avg("ret_20").over(day), "avg_ret_60": F.avg("ret_60").over(day)})
    n = k("trade_day_count")

    def percent(rank: str) -> Column:
        return F.when(n <= 1, 1.0).otherwise(1 - ratio(k(rank) - 1, n - 1))

    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    x = x.withColumns({"pct_rank_ret_20": percent("rank_ret_20"), "pct_rank_ret_60": percent("rank_ret_60"), "pct_rank_amount_ma20": percent("rank_amount"), "pct_rank_vol_20": percent("rank_vol"), "atr_pct_14_pct_rank": percent("rank_atr")})
    return x.withColumns(
        {
            "vol_20_pct_rank": k("pct_rank_vol_20"),
            "amount_ma20_pct_rank": k("pct_rank_amount_ma20"),
            "rs_ret_20": k("ret_20") - k("avg_ret_20"),
            "rs_ret_60": k("ret_60") - k("avg_ret_60"),
            "rs_score": 0.6 * k("pct_rank_ret_20") + 0.4 * k("pct_rank_ret_60"),
            "is_top_ret_20": flag(k("rank_ret_20") <= 10),
            "is_top_ret_60": flag(k("rank_ret_60") <= 10),
            "pct_from_high_60": ratio("c", "high_60") - 1,
            "pct_from_high_120": ratio("c", "high_120") - 1,
            "is_new_high_60": flag(k("c") >= k("high_60")),
            "is_new_high_120": flag(k("c") >= k("high_120")),
            "is_new_high_250": flag(k("c") >= k("high_250")),
            "amount_stability_20": 1 - ratio(F.abs(k("amount_ma20") - k("amount_ma60")), "amount_ma60"),
            "risk_score": 0.5 * k("vol_20") + 0.5 * k("atr_pct_14"),
            "is_high_volatility": flag((k("vol_20") > 0.08) & k("atr_pct_14").isNotNull() | (k("atr_pct_14") > 0.1) & k("vol_20").isNotNull()),
        }
    )


def quality(f: DataFrame) -> DataFrame:
    """Six flags and a score of 100 less their penalties; 0 without a price."""
    k = F.col
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    bad_price = k("c").isNull() | k("o").isNull() | k("h").isNull() | k("l").isNull()
    x = f.withColumns(
        {
            "missing_price_flag": flag(bad_price),
            "zero_amount_flag": flag(k("a").isNull() | (k("a") <= 0) | k("amount_ma20").isNull() | (k("amount_ma20") <= 0)),
            "invalid_ohlc_flag": flag((k("h") < F.greatest("o", "c", "l")) | (k("l") > F.least("o", "c", "h"))),
            "stale_price_flag": flag((k("c") == k("pc")) & (k("v") == 0)),
            "extreme_return_flag": flag((F.abs("pct_chg") > 0.2) | (F.abs("ret_5") > 0.3)),
            "low_history_flag": flag(k("rn") < 60),
        }
    )
    score = 100 - 20 * k("zero_amount_flag") - 20 * k("invalid_ohlc_flag") - 15 * k("stale_price_flag") - 25 * k("extreme_return_flag") - 20 * k("low_history_flag")
    return x.withColumn("quality_score", F.when(k("missing_price_flag") == 1, 0).otherwise(score))
