"""The indicator catalogue over series of adjusted bars.

Layers are plain selects over one window specification, so a query that asks for a few columns computes those alone and
one exchange and one sort of (market, symbol, trade_date) serve all frames.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import frame, full, ratio, series, tie_safe

BASE_WINDOWS = (5, 10, 20, 60, 120, 250)


def base(adj: DataFrame) -> DataFrame:
    """Bars as o, h, l, c, v, a with their predecessors, moves and tradability flags."""
    w = series()
    x = adj.select("market", "symbol", "trade_date", "trade_year", F.col("adj_open").alias("o"), F.col("adj_high").alias("h"), F.col("adj_low").alias("l"), F.col("adj_close").alias("c"), F.col("volume").alias("v"), F.col("amount").alias("a"))
    x = x.withColumns({"rn": F.row_number().over(w).cast("long"), "pc": F.lag("c").over(w), "ph": F.lag("h").over(w), "pl": F.lag("l").over(w)})
    c, pc = F.col("c"), F.col("pc")
    diff, up, down = c - pc, F.col("h") - F.col("ph"), F.col("pl") - F.col("l")
    flag = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)
    gone = pc.isNull() | (pc == 0)
    return x.withColumns(
        {
            "is_limit_up": flag((F.col("o") == F.col("h")) & (c > pc * 1.04)),
            "is_limit_down": flag((F.col("o") == F.col("l")) & (c < pc * 0.96)),
            "is_suspended": flag(F.col("v") == 0),
            "pct_chg": ratio(c, pc) - 1,
            "gain": F.coalesce(F.greatest(diff, F.lit(0.0)), F.lit(0.0)),
            "loss": F.coalesce(F.greatest(-diff, F.lit(0.0)), F.lit(0.0)),
            "tp": (F.col("h") + F.col("l") + c) / 3,
            "tr": F.when(gone, F.col("h") - F.col("l")).otherwise(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - pc), F.abs(F.col("l") - pc))),
            "amp_1": ratio(F.col("h") - F.col("l"), pc),
            "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )


def normalise_windows(windows: list[int]) -> list[int]:
    """Positive, distinct, ascending."""
    if any(int(n) <= 0 for n in windows):
        raise ValueError("windows are positive")
    return sorted({int(n) for n in windows})


def returns(x: DataFrame, windows: tuple[int, ...] = BASE_WINDOWS) -> DataFrame:
    past = {n: F.lag("c", n).over(series()) for n in windows}
    return x.withColumns({"ret_1": F.col("pct_chg")} | {f"ret_{n}": ratio(F.col("c"), p) - 1 for n, p in past.items()})


def rolling(x: DataFrame) -> DataFrame:
    """Means, extremes, deviations and sums; unguarded where a later layer guards them."""
    out: dict[str, Column] = {}
    out |= {f"ma{n}": F.avg("c").over(frame(n)) for n in BASE_WINDOWS}
    out |= {f"vol_ma{n}": F.avg("v").over(frame(n)) for n in (5, 20, 60)}
    out |= {f"amount_ma{n}": F.avg("a").over(frame(n)) for n in (20, 60)}
    out |= {f"high_{n}": F.max("h").over(frame(n)) for n in (9, 20, 60, 120, 250)}
    out |= {f"low_{n}": F.min("l").over(frame(n)) for n in (9, 20, 60, 120, 250)}
    out |= {f"std_pctchg_{n}": F.stddev_samp("pct_chg").over(frame(n)) for n in (5, 10, 20, 60)}
    out |= {f"ret_cnt_{n}": F.count("pct_chg").over(frame(n)) for n in (5, 6, 10, 14, 20, 60)}
    out |= {f"sum_{k}_{n}": F.sum(k).over(frame(n)) for k in ("gain", "loss") for n in (6, 14)}
    out |= {f"sum_{k}_14": F.sum(k).over(frame(14)) for k in ("tr", "plus_dm", "minus_dm")}
    out |= {"tp_ma20": F.avg("tp").over(frame(20)), "tp_std20": F.stddev_samp("tp").over(frame(20)), "close_std20": F.stddev_samp("c").over(frame(20))}
    # Correlation from moments: the built-in one divides by zero on constant frames.
    out |= {"cov20": F.covar_pop("c", F.col("v").cast("double")).over(frame(20)), "sd_c20": F.stddev_pop("c").over(frame(20)), "sd_v20": F.stddev_pop("v").over(frame(20))}
    return x.withColumns(out)


def rsi(n: int) -> Column:
    g, d = F.col(f"sum_gain_{n}"), F.col(f"sum_loss_{n}")
    value = F.when((d == 0) & (g == 0), None).when(d == 0, 100.0).otherwise(100 - 100 / (1 + ratio(g / n, d / n)))
    return full(n, value, f"ret_cnt_{n}")


def technical(x: DataFrame) -> DataFrame:
    """Everything that follows from rolling values; null until a window is full."""
    c = F.col("c")
    k = F.col

    def spread(n: int) -> Column:
        return F.nullif(k(f"high_{n}") - k(f"low_{n}"), F.lit(0.0))

    out = {
        "plus_di_14": full(14, 100 * ratio("sum_plus_dm_14", "sum_tr_14")),
        "minus_di_14": full(14, 100 * ratio("sum_minus_dm_14", "sum_tr_14")),
        "rsv_9": full(9, ratio(c - k("low_9"), spread(9)) * 100),
        "vol_ratio_20": full(20, ratio("v", "vol_ma20") - 1),
        "vol_ratio_5_60": full(60, ratio("vol_ma5", "vol_ma60")),
        "ma_cross_5_20": full(20, ratio("ma5", "ma20") - 1),
        "ma_cross_20_60": full(60, ratio("ma20", "ma60") - 1),
        "range_20": full(20, ratio("high_20", "low_20") - 1),
        "atr_14": full(14, k("sum_tr_14") / 14),
        "atr_pct_14": full(14, ratio(k("sum_tr_14") / 14, c)),
        "bb_mid_20": full(20, k("ma20")),
        "bb_std_20": full(20, k("close_std20")),
        "bb_upper_20": full(20, k("ma20") + 2 * k("close_std20")),
        "bb_lower_20": full(20, k("ma20") - 2 * k("close_std20")),
        "bb_width_20": full(20, ratio(4 * k("close_std20"), "ma20")),
        "bb_z_20": full(20, ratio(c - k("ma20"), "close_std20")),
        "price_vol_corr_20": full(20, ratio("cov20", k("sd_c20") * k("sd_v20"))),
        "rsi_14": rsi(14),
        "rsi_6": rsi(6),
        "cci_20": full(20, ratio(k("tp") - k("tp_ma20"), 0.015 * k("tp_std20"))),
    }
    out |= {f"vol_{n}": full(n, k(f"std_pctchg_{n}"), f"ret_cnt_{n}") for n in (5, 10, 20, 60)}
    out |= {f"bias_{n}": full(n, ratio(c, f"ma{n}") - 1) for n in (5, 10, 20, 60)}
    out |= {f"dd_{n}": full(n, F.when(spread(n).isNotNull(), ratio(c, f"high_{n}") - 1)) for n in (20, 60)}
    out |= {f"pos_{n}": full(n, ratio(c - k(f"low_{n}"), spread(n))) for n in (20, 60)}
    y = x.withColumns(out)
    y = y.withColumn("dx_14", full(14, 100 * ratio(F.abs(k("plus_di_14") - k("minus_di_14")), k("plus_di_14") + k("minus_di_14"))))
    return y.withColumn("adx_14", full(14, F.least(F.lit(100.0), F.greatest(F.lit(0.0), tie_safe(F.avg("dx_14").over(frame(14)), 6)))))


def extra_windows(x: DataFrame, windows: list[int]) -> DataFrame:
    """The ten columns of each window that is not among the standard ones."""
    for n in [n for n in normalise_windows(windows) if n not in BASE_WINDOWS]:
        c, w = F.col("c"), frame(n)
        high, low = F.max("h").over(w), F.min("l").over(w)
        x = x.withColumns({f"ma{n}": F.avg("c").over(w), f"vol_ma{n}": F.avg("v").over(w), f"high_{n}": high, f"low_{n}": low, f"std_{n}": F.stddev_samp("pct_chg").over(w), f"cnt_{n}": F.count("pct_chg").over(w), f"lag_{n}": F.lag("c", n).over(series())})
        hi, lo = F.col(f"high_{n}"), F.col(f"low_{n}")
        wide = F.nullif(hi - lo, F.lit(0.0))
        x = x.withColumns({f"ret_{n}": ratio(c, f"lag_{n}") - 1, f"vol_{n}": full(n, F.col(f"std_{n}"), f"cnt_{n}"), f"range_{n}": full(n, ratio(hi, lo) - 1), f"dd_{n}": full(n, F.when(wide.isNotNull(), ratio(c, hi) - 1)), f"pos_{n}": full(n, ratio(c - lo, wide)), f"bias_{n}": full(n, ratio(c, f"ma{n}") - 1)}).drop(f"std_{n}", f"cnt_{n}", f"lag_{n}")
    return x


STATES = ("macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j")


def state_columns(c: pd.Series, rsv: pd.Series) -> pd.DataFrame:
    """STATES of one series in the order of its days."""
    dif = c.ewm(alpha=2 / 13, adjust=False).mean() - c.ewm(alpha=2 / 27, adjust=False).mean()
    dea = dif.ewm(alpha=0.2, adjust=False).mean()
    known = rsv.dropna()
    start = pd.Series([50.0])
    k = pd.concat([start, known]).ewm(alpha=1 / 3, adjust=False).mean().iloc[1:]
    d = pd.concat([start, k]).ewm(alpha=1 / 3, adjust=False).mean().iloc[1:]
    k.index = d.index = known.index
    out = pd.DataFrame({"macd_dif": dif, "macd_dea": dea, "macd_hist": 2 * (dif - dea), "kdj_k": k.reindex(c.index), "kdj_d": d.reindex(c.index)})
    return out.assign(kdj_j=3 * out["kdj_k"] - 2 * out["kdj_d"])


def recursive(x: DataFrame) -> DataFrame:
    """MACD(12, 26, 9) and KDJ(9): states along a series, folded per series in Arrow batches.

    A series is one instrument's history (some thousand bars), which bounds a group. rsv_9 is null at the start of a
    series and on flat ranges; KDJ skips such bars.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trade_date")
        return pd.concat([g[["market", "symbol", "trade_date"]], state_columns(g["c"], g["rsv_9"])], axis=1)

    schema = "market string, symbol string, trade_date date, " + ", ".join(f"{s} double" for s in STATES)
    return x.select("market", "symbol", "trade_date", "c", "rsv_9").groupBy("market", "symbol").applyInPandas(fold, schema)


def with_states(x: DataFrame) -> DataFrame:
    """x with STATES, in the one pass over its series that computes them: no second plan of x and no join back."""

    def fold(g: pa.Table) -> pa.Table:
        g = g.sort_by("trade_date")
        found = state_columns(g.column("c").to_pandas(), g.column("rsv_9").to_pandas())
        for s in STATES:
            g = g.append_column(s, pa.array(found[s], pa.float64(), from_pandas=True))
        return g

    schema = StructType([*x.schema.fields, *[StructField(s, DoubleType()) for s in STATES]])
    return x.groupBy("market", "symbol").applyInArrow(fold, schema)


FACTOR_COLUMNS = [
    *[f"ma{n}" for n in BASE_WINDOWS], "vol_ma5", "vol_ma20", *[f"ret_{n}" for n in (1, *BASE_WINDOWS)], *[f"vol_{n}" for n in (5, 10, 20, 60)],
    *[f"std_pctchg_{n}" for n in (5, 10, 20, 60)], *[f"{k}_{n}" for n in (20, 60, 120, 250) for k in ("high", "low")], "range_20", "dd_20", "dd_60", "pos_20", "pos_60",
    "tr", "atr_14", "atr_pct_14", "bb_mid_20", "bb_std_20", "bb_upper_20", "bb_lower_20", "bb_width_20", "bb_z_20", "rsi_14", "rsi_6", "cci_20",
    "plus_di_14", "minus_di_14", "adx_14", "rsv_9", "bias_5", "bias_10", "bias_20", "bias_60", "ma_cross_5_20", "ma_cross_20_60", "amount_ma20", "amount_ma60",
    "amp_1", "vol_ratio_20", "vol_ratio_5_60", "price_vol_corr_20", "pct_chg", "is_limit_up", "is_limit_down", "is_suspended",
]


def factors(adj: DataFrame, windows: list[int] | None = None, states: bool = False, columns: list[str] | None = None) -> DataFrame:
    """All indicator columns (adj_close first); with states=True MACD and KDJ too.

    States are joined on, so that columns a caller does not read are never computed. Where `columns` names what it reads,
    these pass through the fold of the states instead: one plan of the indicators and no join.
    """
    x = technical(rolling(returns(base(adj))))
    if windows:
        x = extra_windows(x, windows)
    x = x.withColumn("adj_close", F.col("c"))
    if states and columns:
        return with_states(x.select(*dict.fromkeys(["market", "symbol", "trade_date", "c", "rsv_9", *columns])))
    if states:
        x = x.join(recursive(x), ["market", "symbol", "trade_date"], "left")
    return x.select(*dict.fromkeys(["market", "symbol", "trade_date", *columns])) if columns else x
