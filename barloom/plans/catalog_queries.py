"""Queries of the query layer, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import oracle
from ..functions.columns import display, tie_safe
from ..operators import catalogue
from ..operators.cross_section import cross_section, quality
from ..sources.bars import raw_daily
from . import catalog as ct
from .factor_queries import adjusted, all_factors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = lambda e, p=6: oracle.rnd(e, p)

QUERIES["table_summary"] = lambda s, d: ct.table_summary(raw_daily(s, d))
ORACLE["table_summary"] = oracle.sql("SELECT count(*) AS rows, count(DISTINCT market || symbol) AS symbols, min(trade_date) AS first_date, max(trade_date) AS last_date FROM raw", "raw")
QUERIES["select_filtered"] = lambda s, d: ct.select(raw_daily(s, d), ["market", "symbol", "trade_date", "close", "volume"], market="sz", start="1996-01-01", end="1998-12-31", where="close > open and volume > 1000000")
ORACLE["select_filtered"] = oracle.sql("SELECT market, symbol, trade_date, close, volume FROM raw WHERE market = 'sz' AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND close > open AND volume > 1000000", "raw")
COLUMNS = ["ma20", "ret_20", "rsi_14"]


def stock(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    bars = None if mode == "raw" else adjusted(spark, sf_dir, f"{mode}_factor")
    v = ct.stock_view(raw_daily(spark, sf_dir), bars, all_factors(spark, sf_dir), COLUMNS)
    return v.select("market", "symbol", "trade_date", tie_safe("adj_close", 6).alias("adj_close"), "volume", "adj_factor", *[tie_safe(c, 6).alias(c) for c in COLUMNS])


for _mode, _step in (("raw", "raw"), ("qfq", "adj"), ("hfq", "hfq")):
    QUERIES[f"stock_view_{_mode}"] = lambda s, d, m=_mode: stock(s, d, m)
    _bars = "SELECT market, symbol, trade_date, close AS adj_close, volume, 1.0::DOUBLE AS adj_factor FROM raw" if _mode == "raw" else f"SELECT market, symbol, trade_date, adj_close, volume, adj_factor FROM {_step}"
    ORACLE[f"stock_view_{_mode}"] = oracle.sql(f"SELECT market, symbol, trade_date, {R('b.adj_close')} AS adj_close, b.volume, b.adj_factor, {R('ma20')} AS ma20, {R('ret_20')} AS ret_20, {R('rsi_14')} AS rsi_14 FROM ({_bars}) b LEFT JOIN (SELECT market, symbol, trade_date, ma20, ret_20, rsi_14 FROM tech) USING (market, symbol, trade_date)", "tech", _step)

QUERIES["symbol_macro"] = lambda s, d: raw_daily(s, d).select("market", "symbol").distinct().select(F.explode(F.array(display(), F.concat("market", "symbol"), F.col("symbol"))).alias("x")).select("x", ct.symbol_code("x").alias("code"), ct.symbol_market("x").alias("market"))
ORACLE["symbol_macro"] = oracle.sql("SELECT x, CASE WHEN strpos(x, '.') > 0 THEN split_part(x, '.', 1) WHEN length(x) = 8 AND regexp_matches(x, '^[A-Za-z]{2}') THEN substr(x, 3, 6) ELSE x END AS code, CASE WHEN strpos(x, '.') > 0 THEN lower(split_part(x, '.', 2)) WHEN length(x) = 8 AND regexp_matches(x, '^[A-Za-z]{2}') THEN lower(substr(x, 1, 2)) END AS market FROM (SELECT unnest([symbol || '.' || upper(market), market || symbol, symbol]) AS x FROM (SELECT DISTINCT market, symbol FROM raw))", "raw")
QUERIES["last_n_days"] = lambda s, d: ct.last_n(adjusted(s, d), 5).select("market", "symbol", "trade_date", "recency", tie_safe("adj_close", 6).alias("adj_close"), "volume")
ORACLE["last_n_days"] = oracle.sql(f"SELECT market, symbol, trade_date, recency, {R('adj_close')} AS adj_close, volume FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY trade_date DESC) AS recency FROM adj) WHERE recency <= 5", "adj")
QUERIES["last_n_factors"] = lambda s, d: ct.last_n(all_factors(s, d), 5).select("market", "symbol", "trade_date", "recency", *[tie_safe(c, 6).alias(c) for c in COLUMNS])
ORACLE["last_n_factors"] = oracle.sql(f"SELECT market, symbol, trade_date, recency, {R('ma20')} AS ma20, {R('ret_20')} AS ret_20, {R('rsi_14')} AS rsi_14 FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY trade_date DESC) AS recency FROM tech) WHERE recency <= 5", "tech")
QUERIES["factor_rank"] = lambda s, d: ct.factor_rank(all_factors(s, d), "ret_20", 5).select("trade_date", "rank", "market", "symbol", tie_safe("ret_20", 6).alias("ret_20"))
ORACLE["factor_rank"] = oracle.sql(f"SELECT trade_date, rank, market, symbol, {R('ret_20')} AS ret_20 FROM (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY ret_20 DESC NULLS LAST, market, symbol) AS rank FROM tech) WHERE rank <= 5", "tech")
QUERIES["trading_dates"] = lambda s, d: raw_daily(s, d).select("trade_date").distinct().withColumn("next_date", F.lead("trade_date").over(Window.orderBy("trade_date")))
ORACLE["trading_dates"] = oracle.sql("SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM raw)", "raw")
QUERIES["asof_date"] = lambda s, d: raw_daily(s, d).where(F.col("trade_date") <= F.lit("1999-06-30").cast("date")).groupBy("market").agg(F.max("trade_date").alias("as_of"))
ORACLE["asof_date"] = oracle.sql("SELECT market, max(trade_date) AS as_of FROM raw WHERE trade_date <= DATE '1999-06-30' GROUP BY 1", "raw")

NAMES = [n for n, *_ in catalogue.DEFINITIONS]
QUERIES["factor_describe"] = lambda s, d: catalogue.describe(quality(cross_section(all_factors(s, d))))
ORACLE["factor_describe"] = oracle.sql(
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{g}' AS \"group\", {str(up).lower()} AS higher_is_better, count(*) AS rows, count({n}) AS known, {R(f'min({n})::DOUBLE')} AS least, {R(f'avg({n}::DOUBLE)')} AS mean, {R(f'max({n})::DOUBLE')} AS most FROM {'q' if g == 'quality' else 'xs'}"
        for n, g, _, up in catalogue.DEFINITIONS
    ),
    "xs",
    "q",
)
