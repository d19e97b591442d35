"""DuckDB text of the same computations, assembled from named steps; the driver compares its rows with the DataFrames'."""

from __future__ import annotations

from .operators.indicators import BASE_WINDOWS

W = "PARTITION BY market, symbol ORDER BY trade_date"


def over(n: int) -> str:
    return f"OVER (PARTITION BY market, symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rnd(expr: str, places: int, half: float = 0.5) -> str:
    return f"floor(({expr}) * 1e{places} + {half}) / 1e{places}"


#: Results are rounded a little above the half: means of lattice prices over up to 250 bars never lie on such a tie.
OFF_TIE = 0.5003


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST(({b}) AS DOUBLE), 0))"


def full(n: int, expr: str, count: str = "rn") -> str:
    return f"CASE WHEN {count} >= {n} THEN {expr} END"


def adjusted(factor: str) -> str:
    return f"""SELECT r.market, r.symbol, r.trade_date, trade_year, open * coalesce(f.f, 1.0::DOUBLE) AS adj_open, high * coalesce(f.f, 1.0::DOUBLE) AS adj_high,
  low * coalesce(f.f, 1.0::DOUBLE) AS adj_low, close * coalesce(f.f, 1.0::DOUBLE) AS adj_close,
  CASE WHEN coalesce(f.f, 0) = 0 THEN volume ELSE CAST(floor(volume / f.f + 0.5) AS BIGINT) END AS volume, amount, coalesce(f.f, 1.0::DOUBLE) AS adj_factor
FROM raw r ASOF LEFT JOIN (SELECT market, symbol, coalesce(start_date, trade_date) AS s, coalesce({factor}, 1.0::DOUBLE) AS f FROM fac) f
  ON r.market = f.market AND r.symbol = f.symbol AND r.trade_date >= f.s"""


def rolling() -> str:
    out = [f"lag(c, {n}) OVER ({W}) AS lag_{n}" for n in BASE_WINDOWS]
    out += [f"avg(c) {over(n)} AS ma{n}" for n in BASE_WINDOWS]
    out += [f"avg(v) {over(n)} AS vol_ma{n}" for n in (5, 20, 60)] + [f"avg(a) {over(n)} AS amount_ma{n}" for n in (20, 60)]
    out += [f"max(h) {over(n)} AS high_{n}, min(l) {over(n)} AS low_{n}" for n in (9, 20, 60, 120, 250)]
    out += [f"stddev_samp(pct_chg) {over(n)} AS std_pctchg_{n}" for n in (5, 10, 20, 60)] + [f"count(pct_chg) {over(n)} AS ret_cnt_{n}" for n in (5, 6, 10, 14, 20, 60)]
    out += [f"sum({k}) {over(n)} AS sum_{k}_{n}" for k in ("gain", "loss") for n in (6, 14)] + [f"sum({k}) {over(14)} AS sum_{k}_14" for k in ("tr", "plus_dm", "minus_dm")]
    out += [f"avg(tp) {over(20)} AS tp_ma20, stddev_samp(tp) {over(20)} AS tp_std20, stddev_samp(c) {over(20)} AS close_std20"]
    out += [f"covar_pop(c, v::DOUBLE) {over(20)} AS cov20, stddev_pop(c) {over(20)} AS sd_c20, stddev_pop(v) {over(20)} AS sd_v20"]
    return "SELECT *, " + ",\n  ".join(out) + " FROM base"


def rsi(n: int) -> str:
    return full(n, f"CASE WHEN sum_loss_{n} = 0 AND sum_gain_{n} = 0 THEN NULL WHEN sum_loss_{n} = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + (sum_gain_{n} / {n}) / (sum_loss_{n} / {n})) END", f"ret_cnt_{n}")


def technical() -> str:
    out = {f"ret_{n}": div("c", f"lag_{n}") + " - 1" for n in BASE_WINDOWS} | {"ret_1": "pct_chg"}
    out |= {f"vol_{n}": full(n, f"std_pctchg_{n}", f"ret_cnt_{n}") for n in (5, 10, 20, 60)}
    out |= {f"bias_{n}": full(n, div("c", f"ma{n}") + " - 1") for n in (5, 10, 20, 60)}
    out |= {f"dd_{n}": full(n, f"CASE WHEN high_{n} <> low_{n} THEN {div('c', f'high_{n}')} - 1 END") for n in (20, 60)}
    out |= {f"pos_{n}": full(n, div(f"c - low_{n}", f"high_{n} - low_{n}")) for n in (20, 60)}
    out |= {
        "plus_di_14": full(14, "100 * " + div("sum_plus_dm_14", "sum_tr_14")),
        "minus_di_14": full(14, "100 * " + div("sum_minus_dm_14", "sum_tr_14")),
        "rsv_9": full(9, div("c - low_9", "high_9 - low_9") + " * 100"),
        "vol_ratio_20": full(20, div("v", "vol_ma20") + " - 1"),
        "vol_ratio_5_60": full(60, div("vol_ma5", "vol_ma60")),
        "ma_cross_5_20": full(20, div("ma5", "ma20") + " - 1"),
        "ma_cross_20_60": full(60, div("ma20", "ma60") + " - 1"),
        "range_20": full(20, div("high_20", "low_20") + " - 1"),
        "atr_14": full(14, "sum_tr_14 / 14"),
        "atr_pct_14": full(14, div("sum_tr_14 / 14", "c")),
        "bb_mid_20": full(20, "ma20"),
        "bb_std_20": full(20, "close_std20"),
        "bb_upper_20": full(20, "ma20 + 2 * close_std20"),
        "bb_lower_20": full(20, "ma20 - 2 * close_std20"),
        "bb_width_20": full(20, div("4 * close_std20", "ma20")),
        "bb_z_20": full(20, div("c - ma20", "close_std20")),
        "price_vol_corr_20": full(20, div("cov20", "sd_c20 * sd_v20")),
        "rsi_14": rsi(14),
        "rsi_6": rsi(6),
        "cci_20": full(20, div("tp - tp_ma20", "0.015::DOUBLE * tp_std20")),
    }
    return "SELECT *, c AS adj_close, " + ",\n  ".join(f"{e} AS {k}" for k, e in out.items()) + " FROM roll"


def percent(rank: str) -> str:
    return f"CASE WHEN trade_day_count <= 1 THEN 1.0::DOUBLE ELSE 1 - ({rank} - 1) / (trade_day_count - 1)::DOUBLE END"


STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), """SELECT market, symbol, trade_date, CAST(year(trade_date) AS INT) AS trade_year, open, floor(greatest(open, close) * (1 + 0.1::DOUBLE * mx) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS high,
  floor(least(open, close) * (1 - 0.1::DOUBLE * mn) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS low, close, CAST(q * 100000 AS BIGINT) AS volume, CAST(floor(q * 100000 * close + 0.5::DOUBLE) AS DOUBLE) AS amount
FROM (SELECT *, floor(100 * exp(0.5::DOUBLE * cum) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS close, floor(100 * exp(0.5::DOUBLE * (cum - step)) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS open
  FROM (SELECT *, sum(step) OVER (PARTITION BY market, symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'sh' WHEN 1 THEN 'sz' ELSE 'bj' END AS market, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
        avg(l_discount) - 0.05::DOUBLE AS step, max(l_tax) AS mx, min(l_tax) AS mn, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)))"""),
    "fac": (("raw",), """SELECT market, symbol, trade_date, trade_date AS start_date, CAST(NULL AS DATE) AS end_date, 0.5::DOUBLE + (day(trade_date) % 10) / 10.0::DOUBLE AS qfq_factor,
  1.0::DOUBLE + (day(trade_date) % 10) / 20.0::DOUBLE AS hfq_factor, 'adapter' AS source FROM raw WHERE day(trade_date) IN (3, 17)"""),
    "adj": (("raw", "fac"), adjusted("qfq_factor")),
    "hfq": (("raw", "fac"), adjusted("hfq_factor")),
    "base": (("adj",), f"""SELECT *, CASE WHEN o = h AND c > pc * 1.04::DOUBLE THEN 1 ELSE 0 END AS is_limit_up, CASE WHEN o = l AND c < pc * 0.96::DOUBLE THEN 1 ELSE 0 END AS is_limit_down,
  CASE WHEN v = 0 THEN 1 ELSE 0 END AS is_suspended, {div('c', 'pc')} - 1 AS pct_chg, coalesce(greatest(CASE WHEN pc IS NOT NULL THEN c - pc END, CASE WHEN pc IS NOT NULL THEN 0.0::DOUBLE END), 0) AS gain,
  coalesce(greatest(CASE WHEN pc IS NOT NULL THEN pc - c END, CASE WHEN pc IS NOT NULL THEN 0.0::DOUBLE END), 0) AS loss, (h + l + c) / 3 AS tp,
  CASE WHEN pc IS NULL OR pc = 0 THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr, {div('h - l', 'pc')} AS amp_1,
  CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0.0::DOUBLE END AS plus_dm, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0.0::DOUBLE END AS minus_dm
FROM (SELECT market, symbol, trade_date, trade_year, adj_open AS o, adj_high AS h, adj_low AS l, adj_close AS c, volume AS v, amount AS a, row_number() OVER ({W}) AS rn,
  lag(adj_close) OVER ({W}) AS pc, lag(adj_high) OVER ({W}) AS ph, lag(adj_low) OVER ({W}) AS pl FROM adj)"""),
    "roll": (("base",), rolling()),
    "tech0": (("roll",), technical()),
    "tech1": (("tech0",), f"SELECT *, {full(14, '100 * ' + div('abs(plus_di_14 - minus_di_14)', 'plus_di_14 + minus_di_14'))} AS dx_14 FROM tech0"),
    "tech": (("tech1",), f"SELECT *, {full(14, 'least(100.0::DOUBLE, greatest(0.0::DOUBLE, ' + rnd(f'avg(dx_14) {over(14)}', 6) + '))')} AS adx_14 FROM tech1"),
    "xs0": (("tech",), """SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY ret_20 DESC NULLS LAST, market, symbol) AS rank_ret_20, rank() OVER (PARTITION BY trade_date ORDER BY ret_60 DESC NULLS LAST, market, symbol) AS rank_ret_60,
  rank() OVER (PARTITION BY trade_date ORDER BY amount_ma20 DESC NULLS LAST, market, symbol) AS rank_amount, rank() OVER (PARTITION BY trade_date ORDER BY vol_20 ASC NULLS LAST, market, symbol) AS rank_vol,
  rank() OVER (PARTITION BY trade_date ORDER BY atr_pct_14 ASC NULLS LAST, market, symbol) AS rank_atr, count(*) OVER (PARTITION BY trade_date) AS trade_day_count,
  avg(ret_20) OVER (PARTITION BY trade_date) AS avg_ret_20, avg(ret_60) OVER (PARTITION BY trade_date) AS avg_ret_60 FROM tech"""),
    "xs1": (("xs0",), f"SELECT *, {percent('rank_ret_20')} AS pct_rank_ret_20, {percent('rank_ret_60')} AS pct_rank_ret_60, {percent('rank_amount')} AS pct_rank_amount_ma20, {percent('rank_vol')} AS pct_rank_vol_20, {percent('rank_atr')} AS atr_pct_14_pct_rank FROM xs0"),
    "xs": (("xs1",), f"""SELECT *, pct_rank_vol_20 AS vol_20_pct_rank, pct_rank_amount_ma20 AS amount_ma20_pct_rank, ret_20 - avg_ret_20 AS rs_ret_20, ret_60 - avg_ret_60 AS rs_ret_60, 0.6::DOUBLE * pct_rank_ret_20 + 0.4::DOUBLE * pct_rank_ret_60 AS rs_score,
  CAST(rank_ret_20 <= 10 AS INT) AS is_top_ret_20, CAST(rank_ret_60 <= 10 AS INT) AS is_top_ret_60, {div('c', 'high_60')} - 1 AS pct_from_high_60, {div('c', 'high_120')} - 1 AS pct_from_high_120,
  CAST(c >= high_60 AS INT) AS is_new_high_60, CAST(c >= high_120 AS INT) AS is_new_high_120, CAST(c >= high_250 AS INT) AS is_new_high_250, 1 - {div('abs(amount_ma20 - amount_ma60)', 'amount_ma60')} AS amount_stability_20,
  0.5::DOUBLE * vol_20 + 0.5::DOUBLE * atr_pct_14 AS risk_score, CASE WHEN vol_20 IS NOT NULL AND atr_pct_14 IS NOT NULL AND (vol_20 > 0.08 OR atr_pct_14 > 0.1) THEN 1 ELSE 0 END AS is_high_volatility FROM xs1"""),
    "q0": (("tech",), """SELECT *, CASE WHEN c IS NULL OR o IS NULL OR h IS NULL OR l IS NULL THEN 1 ELSE 0 END AS missing_price_flag, CASE WHEN a IS NULL OR a <= 0 OR amount_ma20 IS NULL OR amount_ma20 <= 0 THEN 1 ELSE 0 END AS zero_amount_flag,
  CASE WHEN h < greatest(o, c, l) OR l > least(o, c, h) THEN 1 ELSE 0 END AS invalid_ohlc_flag, CASE WHEN c = pc AND v = 0 THEN 1 ELSE 0 END AS stale_price_flag,
  CASE WHEN abs(pct_chg) > 0.2 OR abs(ret_5) > 0.3 THEN 1 ELSE 0 END AS extreme_return_flag, CASE WHEN rn < 60 THEN 1 ELSE 0 END AS low_history_flag FROM tech"""),
    "q": (("q0",), "SELECT *, CAST(CASE WHEN missing_price_flag = 1 THEN 0 ELSE 100 - 20 * zero_amount_flag - 20 * invalid_ohlc_flag - 15 * stale_price_flag - 25 * extreme_return_flag - 20 * low_history_flag END AS INT) AS quality_score FROM q0"),
}


#: Steps that several others read.
KEPT = {"raw", "base", "tech"}


def needs(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*needs(STEPS[n][0]), n]:
            if m not in out:
                out.append(m)
    return out


def sql(select: str, *names: str, extra: str = "") -> str:
    """WITH the named steps and what they need, then extra steps, then select."""
    steps = [f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({STEPS[n][1]})" for n in needs(names)]
    return "WITH RECURSIVE " + ",\n".join(steps + ([extra] if extra else [])) + "\n" + select


def columns(spec: dict[str, int | None]) -> str:
    """Select list of the key and columns, rounded where places are given."""
    return "market, symbol, trade_date, " + ", ".join(f"{rnd(c, p, OFF_TIE)} AS {c}" if p is not None else c for c, p in spec.items())
