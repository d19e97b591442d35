"""The catalogue of cross-sectional and quality factors, and what a table holds of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tie_safe

#: Name, group, what it is computed from, whether more is better.
DEFINITIONS = [
    ("rank_ret_20", "xsec", ["ret_20"], False),
    ("rank_ret_60", "xsec", ["ret_60"], False),
    ("pct_rank_ret_20", "xsec", ["ret_20"], True),
    ("pct_rank_amount_ma20", "xsec", ["amount_ma20"], True),
    ("pct_rank_vol_20", "xsec", ["vol_20"], True),
    ("rs_ret_20", "relative_strength", ["ret_20"], True),
    ("rs_ret_60", "relative_strength", ["ret_60"], True),
    ("rs_score", "relative_strength", ["ret_20", "ret_60"], True),
    ("is_top_ret_20", "relative_strength", ["ret_20"], True),
    ("is_top_ret_60", "relative_strength", ["ret_60"], True),
    ("is_new_high_60", "trend", ["adj_close", "high_60"], True),
    ("is_new_high_120", "trend", ["adj_close", "high_120"], True),
    ("is_new_high_250", "trend", ["adj_close", "high_250"], True),
    ("pct_from_high_60", "trend", ["adj_close", "high_60"], True),
    ("pct_from_high_120", "trend", ["adj_close", "high_120"], True),
    ("amount_ma20_pct_rank", "liquidity", ["amount_ma20"], True),
    ("amount_stability_20", "liquidity", ["amount_ma20", "amount_ma60"], True),
    ("vol_20_pct_rank", "risk", ["vol_20"], True),
    ("atr_pct_14_pct_rank", "risk", ["atr_pct_14"], True),
    ("risk_score", "risk", ["vol_20", "atr_pct_14", "rsi_14"], False),
    ("is_high_volatility", "risk", ["vol_20", "atr_pct_14"], False),
    ("missing_price_flag", "quality", ["adj_open", "adj_high", "adj_low", "adj_close"], False),
    ("zero_amount_flag", "quality", ["amount", "amount_ma20"], False),
    ("invalid_ohlc_flag", "quality", ["adj_open", "adj_high", "adj_low", "adj_close"], False),
    ("stale_price_flag", "quality", ["adj_close", "volume"], False),
    ("extreme_return_flag", "quality", ["pct_chg", "ret_5"], False),
    ("low_history_flag", "quality", ["rn"], False),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, group, depends_on, higher_is_better) of every factor."""
    return spark.createDataFrame(DEFINITIONS, "name string, group string, depends_on array<string>, higher_is_better boolean")


def describe(f: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, group, higher_is_better, rows, known, least, mean, most) of the catalogue's factors, or the named ones, over a table.

    All factors are aggregates of one scan; a factor that the table does not have is an error, as is an unknown name.
    """
    own = [d for d in DEFINITIONS if names is None or d[0] in names]
    if unknown := set(names or []) - {d[0] for d in own}:
        raise KeyError(f"no such factor: {sorted(unknown)}")
    if absent := {d[0] for d in own} - set(f.columns):
        raise ValueError(f"not in the table: {sorted(absent)}")
    c = lambda n: F.col(n).cast("double")
    row = lambda n: F.struct(F.lit(n).alias("name"), F.count("*").alias("rows"), F.count(n).alias("known"), F.min(c(n)).alias("least"), F.avg(c(n)).alias("mean"), F.max(c(n)).alias("most"))
    found = f.agg(F.array(*[row(d[0]) for d in own]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    out = found.join(F.broadcast(catalogue(f.sparkSession)), "name")
    return out.select("name", "group", "higher_is_better", "rows", "known", *[tie_safe(n, 6).alias(n) for n in ("least", "mean", "most")])


def best_by(f: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Every day's n best rows by a factor of the catalogue, in the direction that it names."""
    better = next((d[3] for d in DEFINITIONS if d[0] == name), None)
    if better is None:
        raise KeyError(f"no such factor: {name}")
    from ..plans.catalog import factor_rank

    return factor_rank(f, name, n, better)


