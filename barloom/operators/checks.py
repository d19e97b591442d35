"""Data-quality checks: one aggregation a table, one row a metric with its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(df: DataFrame, rules: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """(metric, value, level) of rules name -> (aggregate, level where the value is over 0, else ok)."""
    one = df.agg(*[c.cast("long").alias(k) for k, (c, _, _) in rules.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.when(F.col(k) > 0, bad).otherwise(good).alias("level")) for k, (_, bad, good) in rules.items()])
    return one.select(F.explode(rows).alias("m")).select("m.*")


def number(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def raw_daily(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    return metrics(
        df,
        {
            "rows": (F.count("*"), "info", "info"),
            "symbols": (F.countDistinct("market", "symbol"), "info", "info"),
            "non_positive_price": (number((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)), "warn", "ok"),
            "invalid_ohlc": (number((h < F.greatest(o, c, l)) | (l > F.least(o, c, h))), "error", "ok"),
            "negative_volume": (number((F.col("volume") < 0) | (F.col("amount") < 0)), "error", "ok"),
        },
    )


RAW_SQL = """SELECT m.metric, m.value, m.level FROM (SELECT unnest([
  {'metric': 'rows', 'value': n, 'level': 'info'}, {'metric': 'symbols', 'value': s, 'level': 'info'}, {'metric': 'non_positive_price', 'value': p, 'level': CASE WHEN p > 0 THEN 'warn' ELSE 'ok' END},
  {'metric': 'invalid_ohlc', 'value': i, 'level': CASE WHEN i > 0 THEN 'error' ELSE 'ok' END}, {'metric': 'negative_volume', 'value': v, 'level': CASE WHEN v > 0 THEN 'error' ELSE 'ok' END}]) AS m
FROM (SELECT count(*) AS n, count(DISTINCT market || ':' || symbol) AS s, count(*) FILTER (least(open, high, low, close) <= 0) AS p, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS i,
  count(*) FILTER (volume < 0 OR amount < 0) AS v FROM raw))"""


def adjusted(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(f"adj_{x}") for x in ("open", "high", "low", "close"))  # noqa: E741
    return metrics(
        df,
        {
            "rows": (F.count("*"), "info", "info"),
            "bad_factor": (number(F.col("adj_factor") <= 0), "error", "ok"),
            "invalid_ohlc": (number((h < F.greatest(o, c, l)) | (l > F.least(o, c, h))), "error", "ok"),
            "non_positive_price": (number((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)), "warn", "ok"),
        },
    )


ADJ_SQL = """SELECT m.metric, m.value, m.level FROM (SELECT unnest([{'metric': 'rows', 'value': n, 'level': 'info'}, {'metric': 'bad_factor', 'value': f, 'level': CASE WHEN f > 0 THEN 'error' ELSE 'ok' END},
  {'metric': 'invalid_ohlc', 'value': i, 'level': CASE WHEN i > 0 THEN 'error' ELSE 'ok' END}, {'metric': 'non_positive_price', 'value': p, 'level': CASE WHEN p > 0 THEN 'warn' ELSE 'ok' END}]) AS m
FROM (SELECT count(*) AS n, count(*) FILTER (adj_factor <= 0) AS f, count(*) FILTER (adj_high < greatest(adj_open, adj_close, adj_low) OR adj_low > least(adj_open, adj_close, adj_high)) AS i,
  count(*) FILTER (least(adj_open, adj_high, adj_low, adj_close) <= 0) AS p FROM adj))"""


def adjustment(df: DataFrame) -> DataFrame:
    return metrics(df, {"rows": (F.count("*"), "info", "info"), "bad_qfq": (number(F.col("qfq_factor") <= 0), "error", "ok"), "bad_hfq": (number(F.col("hfq_factor") <= 0), "error", "ok")})


FACTOR_SQL = """SELECT m.metric, m.value, m.level FROM (SELECT unnest([{'metric': 'rows', 'value': n, 'level': 'info'}, {'metric': 'bad_qfq', 'value': q, 'level': CASE WHEN q > 0 THEN 'error' ELSE 'ok' END},
  {'metric': 'bad_hfq', 'value': h, 'level': CASE WHEN h > 0 THEN 'error' ELSE 'ok' END}]) AS m FROM (SELECT count(*) AS n, count(*) FILTER (qfq_factor <= 0) AS q, count(*) FILTER (hfq_factor <= 0) AS h FROM fac))"""


#: What :func:`factors` reads besides the states.
INDICATORS = ["pct_chg", "vol_20", "atr_14", "rsi_14", "adx_14", "bb_width_20"]


def factors(df: DataFrame) -> DataFrame:
    """Null and extreme returns warn; values outside an indicator's range are errors."""
    k = F.col
    outside = lambda c: (k(c) < 0) | (k(c) > 100)
    return metrics(
        df,
        {
            "rows": (F.count("*"), "info", "info"),
            "null_pct_chg_over_tenth": ((number(k("pct_chg").isNull()) > 0.1 * F.count("*")).cast("int"), "warn", "ok"),
            "extreme_pct_chg": (number(F.abs("pct_chg") > 0.5), "warn", "ok"),
            "negative_vol": (number(k("vol_20") < 0), "error", "ok"),
            "negative_atr": (number(k("atr_14") < 0), "error", "ok"),
            "rsi_range": (number(outside("rsi_14")), "error", "ok"),
            "kd_range": (number(outside("kdj_k") | outside("kdj_d")), "error", "ok"),
            "adx_range": (number(outside("adx_14")), "error", "ok"),
            "negative_bb_width": (number(k("bb_width_20") < 0), "error", "ok"),
        },
    )


_COUNTS = {
    "null_pct_chg_over_tenth": ("CAST(count(*) FILTER (pct_chg IS NULL) > 0.1::DOUBLE * count(*) AS BIGINT)", "warn"),
    "extreme_pct_chg": ("count(*) FILTER (abs(pct_chg) > 0.5)", "warn"),
    "negative_vol": ("count(*) FILTER (vol_20 < 0)", "error"),
    "negative_atr": ("count(*) FILTER (atr_14 < 0)", "error"),
    "rsi_range": ("count(*) FILTER (rsi_14 < 0 OR rsi_14 > 100)", "error"),
    "kd_range": ("count(*) FILTER (k < 0 OR k > 100 OR d < 0 OR d > 100)", "error"),
    "adx_range": ("count(*) FILTER (adx_14 < 0 OR adx_14 > 100)", "error"),
    "negative_bb_width": ("count(*) FILTER (bb_width_20 < 0)", "error"),
}
INDICATOR_SQL = f"""SELECT m.metric, m.value, m.level FROM (SELECT unnest([{{'metric': 'rows', 'value': n, 'level': 'info'}}, {', '.join(f"{{'metric': '{c}', 'value': {c}, 'level': CASE WHEN {c} > 0 THEN '{level}' ELSE 'ok' END}}" for c, (_, level) in _COUNTS.items())}]) AS m
FROM (SELECT count(*) AS n, {', '.join(f"{count} AS {c}" for c, (count, _) in _COUNTS.items())} FROM tech LEFT JOIN (SELECT market, symbol, trade_date, k, d FROM m) USING (market, symbol, trade_date)))"""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
