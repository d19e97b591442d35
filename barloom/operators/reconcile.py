"""Comparing two adjusted series, finding changed history, and deriving factors from two series of closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tie_safe

THRESHOLD = 0.01


def compare(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """By symbol: common, one-sided and mismatching days, largest error, and whether all agree."""
    a = left.select("market", "symbol", "trade_date", F.col("adj_close").alias("x"))
    b = right.select("market", "symbol", "trade_date", F.col("adj_close").alias("y"))
    both = a.join(b, ["market", "symbol", "trade_date"], "full_outer")
    err = F.abs(F.col("x") - F.col("y"))
    out = both.groupBy("market", "symbol").agg(F.count(err).alias("common"), F.count_if(F.col("y").isNull()).alias("left_only"), F.count_if(F.col("x").isNull()).alias("right_only"), F.count_if(err > threshold).alias("mismatches"), tie_safe(F.coalesce(F.max(err), F.lit(0.0)), 6).alias("max_abs_error"))
    return out.withColumn("ok", (F.col("mismatches") == 0) & (F.col("left_only") == 0) & (F.col("right_only") == 0))


COMPARE_SQL = f"""SELECT *, mismatches = 0 AND left_only = 0 AND right_only = 0 AS ok FROM (SELECT market, symbol, count(abs(x - y)) AS common, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only,
  count(*) FILTER (abs(x - y) > {THRESHOLD}) AS mismatches, floor(coalesce(max(abs(x - y)), 0) * 1e6 + 0.5) / 1e6 AS max_abs_error
FROM (SELECT market, symbol, trade_date, adj_close AS x FROM adj) FULL JOIN (SELECT market, symbol, trade_date, adj_close AS y FROM hfq WHERE day(trade_date) <> 5) USING (market, symbol, trade_date) GROUP BY 1, 2)"""


def changed_history(old: DataFrame, new: DataFrame, until: str) -> DataFrame:
    """Factor rows up to a day that are in one table and not in the other, with the side they are on."""
    cols = ["market", "symbol", "start_date", "qfq_factor", "hfq_factor"]
    cut = lambda df: df.select(*cols).where(F.col("start_date") <= F.lit(until).cast("date"))
    return cut(old).subtract(cut(new)).withColumn("side", F.lit("old")).union(cut(new).subtract(cut(old)).withColumn("side", F.lit("new")))


EXCEPT_SQL = """SELECT *, 'old' AS side FROM (SELECT market, symbol, start_date, qfq_factor, hfq_factor FROM fac WHERE start_date <= DATE '1999-12-31' EXCEPT SELECT market, symbol, start_date, CASE WHEN year(start_date) = 1997 THEN qfq_factor + 0.1::DOUBLE ELSE qfq_factor END, hfq_factor FROM fac WHERE start_date <= DATE '1999-12-31')
UNION ALL SELECT *, 'new' AS side FROM (SELECT market, symbol, start_date, CASE WHEN year(start_date) = 1997 THEN qfq_factor + 0.1::DOUBLE ELSE qfq_factor END AS qfq_factor, hfq_factor FROM fac WHERE start_date <= DATE '1999-12-31' EXCEPT SELECT market, symbol, start_date, qfq_factor, hfq_factor FROM fac WHERE start_date <= DATE '1999-12-31')"""


def derive_factors(raw: DataFrame, exported: DataFrame) -> DataFrame:
    """qfq and hfq factors of the days on which both closes are positive.

    The ratio exported / raw is normalised by the last day's for qfq (so the last is 1) and by the first day's for hfq.
    """
    x = raw.select("market", "symbol", "trade_date", "close").join(exported.select("market", "symbol", "trade_date", "adj_close"), ["market", "symbol", "trade_date"]).where("close > 0 and adj_close > 0")
    all_ = Window.partitionBy("market", "symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = x.withColumn("r", F.col("adj_close") / F.col("close"))
    r = r.withColumns({"head": F.first("r").over(all_), "tail": F.last("r").over(all_)})
    return r.select("market", "symbol", "trade_date", tie_safe(F.try_divide("r", "tail"), 8).alias("qfq_factor"), tie_safe(F.try_divide("r", "head"), 8).alias("hfq_factor"))


def excluded(raw: DataFrame, exported: DataFrame) -> DataFrame:
    """(market, symbol, reason) of the series from which no factors can be derived."""
    a = raw.groupBy("market", "symbol").agg(F.count("*").alias("raw_rows"))
    b = exported.groupBy("market", "symbol").agg(F.count("*").alias("export_rows"))
    good = F.col("close").isNotNull() & F.col("adj_close").isNotNull()
    c = raw.join(exported, ["market", "symbol", "trade_date"]).groupBy("market", "symbol").agg(F.count_if(good).alias("common"), F.count_if(good & (F.col("close") > 0) & (F.col("adj_close") > 0)).alias("positive"))
    x = a.join(b, ["market", "symbol"], "full_outer").join(c, ["market", "symbol"], "left")
    reason = F.when(F.col("export_rows").isNull(), "missing_export_file").when(F.col("raw_rows").isNull(), "missing_raw_file").when(F.coalesce("common", F.lit(0)) == 0, "no_common_dates").when(F.col("positive") == 0, "no_positive_rows")
    return x.select("market", "symbol", reason.alias("reason")).where("reason is not null")


DERIVE_SQL = """SELECT market, symbol, trade_date, floor(r / tail * 1e8 + 0.5) / 1e8 AS qfq_factor, floor(r / head * 1e8 + 0.5) / 1e8 AS hfq_factor FROM (
  SELECT *, first_value(r) OVER w AS head, last_value(r) OVER w AS tail FROM (SELECT market, symbol, trade_date, adj_close / close AS r FROM raw JOIN adj USING (market, symbol, trade_date) WHERE close > 0 AND adj_close > 0)
  WINDOW w AS (PARTITION BY market, symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
