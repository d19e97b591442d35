"""Queries over the strategies, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle
from ..operators.cross_section import cross_section
from . import strategies as st
from .factor_queries import all_factors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P = st.Params()


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_section(all_factors(spark, sf_dir))


def z(c: str) -> str:
    return f"coalesce({c}, 0)"


def cl(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def y(*conds: str) -> str:
    return "(" + " AND ".join(f"coalesce({c}, false)" for c in conds) + ")"


def m(cond: str) -> str:
    return f"coalesce({cond}, true)"


def one(*conds: str) -> str:
    return f"CASE WHEN {y(*conds)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


UP = y("adj_close > ma20", "ma20 > ma60")
REASON = f"""CASE WHEN adj_close IS NULL OR ma20 IS NULL OR ma60 IS NULL OR ret_5 IS NULL OR ret_20 IS NULL OR amount_ma20 IS NULL THEN 'missing_required_factor' WHEN amount_ma20 < {P.min_amount_ma20} THEN 'insufficient_liquidity'
  WHEN ret_5 >= 0.15 THEN 'overheated_ret_5' WHEN rsi_14 >= 85 THEN 'extreme_rsi' WHEN atr_pct_14 >= 0.10 OR vol_20 >= 0.08 THEN 'excessive_volatility' END"""
TREND = f"CASE WHEN {y('ret_20 > 0', 'pos_20 >= 0.85', 'dd_20 >= -0.03', 'vol_ratio_20 > 0')} THEN 'breakout_watch' WHEN {UP} AND {y('ret_20 > 0')} THEN 'strong_trend' WHEN {y('ma20 > ma60', 'adj_close >= ma20', 'ret_5 <= 0', 'ret_20 > 0', 'dd_20 >= -0.12')} THEN 'pullback_watch' END"
RULES = {
    "trend_strength": TREND,
    "multi_factor": TREND,
    "low_vol_breakout": f"CASE WHEN {UP} AND {y('pos_20 >= 0.85')} AND {m('pos_60 >= 0.70')} AND {y('dd_20 >= -0.03', 'vol_ratio_20 >= 0.12', 'vol_20 <= 0.045', 'atr_pct_14 <= 0.05', 'ret_20 > 0')} AND {m('ret_5 <= 0.08')} AND {m('rsi_14 < 78')} THEN 'breakout_watch' END",
    "ma_pullback": f"CASE WHEN {y('adj_close >= 0.97::DOUBLE * ma20', 'adj_close <= 1.03::DOUBLE * ma20', 'ma20 > ma60', 'ret_20 > 0.03')} AND {m('ret_5 <= 0.03')} AND {y('dd_20 >= -0.10')} AND {m('rsi_14 < 72')} AND {m('atr_pct_14 <= 0.06')} THEN 'pullback_watch' END",
    "relative_strength": f"CASE WHEN {UP} AND {y('ret_20 >= 0.08', 'ret_60 >= 0.10')} AND {m('pos_20 >= 0.65')} AND {m('ret_5 <= 0.10')} THEN 'strong_trend' END",
    "volume_breakout": f"CASE WHEN {y('adj_close > ma20', 'pos_20 >= 0.85', 'dd_20 >= -0.03', 'vol_ratio_20 >= 0.25')} AND {m('ret_5 > 0')} AND {m('rsi_14 < 80')} AND {m('vol_20 <= 0.06')} THEN 'breakout_watch' END",
    "mean_reversion": f"CASE WHEN {y(f'rsi_14 < {P.rsi_threshold}', 'adj_close < coalesce(bb_lower_20, ma20 * (1 - 2 * std_pctchg_20))', 'ret_20 < -0.15')} THEN 'oversold_rebound' END",
    "smart_money": f"CASE WHEN {y('vol_ratio_5_60 > 2.5', 'price_vol_corr_20 > 0.6', 'atr_pct_14_pct_rank > 0.8')} THEN 'smart_money' END",
}
MISSING = "(rsi_14 IS NULL OR atr_pct_14 IS NULL OR vol_20 IS NULL)"
LIQ5, MIN = f"{max(5 * P.min_amount_ma20, 1.0)}", f"{max(P.min_amount_ma20, 1.0)}"
PARTS = {
    "trend": f"least(35.0::DOUBLE, 15 * {one('adj_close > ma20')} + 10 * {one('ma20 > ma60')} + 10 * {cl(z('ret_20') + ' / 0.20::DOUBLE')})",
    "liquidity": f"20 * {cl(z('amount_ma20') + f' / {LIQ5}::DOUBLE')}",
    "position": f"20 * {cl(z('pos_20'))}",
    "short_strength": f"15 * {cl('(' + z('ret_5') + ' + 0.05::DOUBLE) / 0.20::DOUBLE')}",
    "breakout": f"20 * {cl('(' + z('pos_20') + ' + ' + z('pos_60') + ') / 1.8::DOUBLE')} + 10 * {cl(z('vol_ratio_20') + ' / 0.5::DOUBLE')}",
    "low_volatility": f"20 * {cl('1 - greatest(' + z('vol_20') + ', ' + z('atr_pct_14') + ') / 0.08::DOUBLE')}",
    "pullback": f"20 * CASE WHEN {z('ma20')} = 0 THEN 0.0::DOUBLE ELSE {cl('1 - abs(' + oracle.div(z('adj_close'), z('ma20')) + ' - 1) / 0.05::DOUBLE')} END + 10 * {cl('greatest(0.0::DOUBLE, -' + z('dd_20') + ') / 0.08::DOUBLE')}",
    "momentum": f"18 * {cl(z('ret_20') + ' / 0.18::DOUBLE')} + 12 * {cl(z('ret_60') + ' / 0.25::DOUBLE')} + 8 * {cl('greatest(' + z('ret_5') + ', 0.0::DOUBLE) / 0.08::DOUBLE')}",
    "volume": f"20 * {cl(z('vol_ratio_20') + ' / 0.5::DOUBLE')} + 10 * {cl('(' + z('amount_ma20') + f' / {MIN}::DOUBLE - 1) / 2')}",
    "oversold": f"25 * {cl('(30 - coalesce(nullif(rsi_14, 0), 30.0::DOUBLE)) / 10')} + 15 * {cl('greatest(0.0::DOUBLE, -' + z('ret_20') + ' - 0.15::DOUBLE) / 0.15::DOUBLE')}",
    "band_reclaim": f"20 * {cl('greatest(0.0::DOUBLE, ' + z('bb_lower_20') + ' - ' + z('adj_close') + ') / greatest(abs(coalesce(nullif(bb_lower_20, 0), nullif(adj_close, 0), 1.0::DOUBLE)), 1.0::DOUBLE)')} + {oracle.rnd('10 * ' + cl('1 - ' + z('std_pctchg_20') + ' / 0.05::DOUBLE'), 2)}",
    "smart_volume": f"20 * {cl(z('vol_ratio_5_60') + ' / 2.5::DOUBLE')} + 10 * {cl(z('price_vol_corr_20') + ' / 0.6::DOUBLE')}",
    "stability": f"15 * {cl(z('atr_pct_14') + ' / 0.05::DOUBLE')}",
}
MORE = {
    "low_vol_breakout": f"- 6 * CASE WHEN {y('atr_pct_14 >= 0.04')} OR {y('vol_20 >= 0.035')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "ma_pullback": f"- 6 * {one('dd_20 < -0.12')}",
    "relative_strength": f"- 4 * CASE WHEN coalesce(ret_60, 0) < 0.10 OR {y('ret_5 >= 0.10')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "volume_breakout": f"- 6 * {one('vol_ratio_20 < 0.25')}",
    "mean_reversion": f"+ 2 * {one('rsi_14 < 30')}",
    "smart_money": f"+ 2 * {one('price_vol_corr_20 > 0.6')}",
}
SETS = {
    "trend_strength": ["trend", "liquidity", "position", "short_strength"],
    "low_vol_breakout": ["trend", "breakout", "low_volatility", "liquidity"],
    "ma_pullback": ["trend", "pullback", "liquidity", "short_strength"],
    "relative_strength": ["trend", "momentum", "position", "liquidity"],
    "volume_breakout": ["trend", "breakout", "volume", "liquidity"],
    "mean_reversion": ["trend", "oversold", "band_reclaim", "liquidity"],
    "smart_money": ["trend", "smart_volume", "stability", "liquidity"],
}


def total_sql(name: str) -> str:
    if name == "multi_factor":
        trend = f"CASE WHEN {UP} THEN 1.0::DOUBLE WHEN {y('adj_close > ma20')} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
        parts = [("0.4", z("pct_rank_ret_20")), ("-0.3", f"(1 - {z('vol_20_pct_rank')})"), ("0.3", z("amount_ma20_pct_rank")), ("0.2", z("rs_score")), ("0.1", trend)]
        total = "(" + " + ".join(oracle.rnd(f"({w}::DOUBLE) * {e}", 6) for w, e in parts) + ") * 100"
    else:
        penalty = f"greatest(-30.0::DOUBLE, -1 * CASE WHEN {MISSING} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 4 * {one('ret_5 >= 0.08')} - 4 * {one('rsi_14 >= 75')} - 4 * CASE WHEN {y('atr_pct_14 >= 0.05')} OR {y('vol_20 >= 0.04')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 2 * {one('dd_20 >= -0.03')} {MORE.get(name, '')})"
        total = " + ".join(oracle.rnd(e, 2) for e in [*[PARTS[p] for p in SETS[name]], penalty])
    return oracle.rnd(f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {total}))", 2)


def joined(*terms: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in terms) + "], lambda x: x IS NOT NULL), ',')"


def tags_sql(name: str) -> str:
    expand = {"low_vol_breakout": "vol_ratio_20 >= 0.20", "volume_breakout": "vol_ratio_20 >= 0.25"}.get(name, "vol_ratio_20 > 0.10")
    return joined((UP, "trend_strong"), (y(expand), "volume_expansion"), (y(f"amount_ma20 >= {st.ACTIVE[name] * P.min_amount_ma20}"), "active_amount"))


def flags_sql(name: str) -> str:
    extra = {"low_vol_breakout": [(f"({y('atr_pct_14 >= 0.04')} OR {y('vol_20 >= 0.035')})", "high_volatility")], "volume_breakout": [(y("vol_ratio_20 >= 0.75", "ret_5 <= 0"), "volume_climax")]}.get(name, [])
    return joined((MISSING, "risk_factor_missing"), (y("ret_5 >= 0.08"), "ret_5_strong"), (y("rsi_14 >= 75"), "rsi_high"), (f"({y('atr_pct_14 >= 0.05')} OR {y('vol_20 >= 0.04')})", "mild_volatility"), *extra, (y("dd_20 >= -0.03"), "near_20d_high"))


def scored_sql(name: str) -> str:
    return f"""SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN candidate_type IS NULL THEN 'unclassified_filtered' WHEN score < {P.min_score} THEN 'low_score_filtered' ELSE 'picked' END AS status
FROM (SELECT *, {REASON} AS reason, {RULES[name]} AS candidate_type, {tags_sql(name)} AS tags, {flags_sql(name)} AS risk_flags, {total_sql(name)} AS score FROM xs)"""


def picks_sql(name: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, amount_ma20 DESC NULLS LAST, market, symbol) AS rank, '{name}' AS strategy FROM ({scored_sql(name)}) WHERE status = 'picked') WHERE rank <= {P.limit}"


def show(x: DataFrame) -> DataFrame:
    return x.select("trade_date", "market", "symbol", "candidate_type", "score", "rank", "priority_weight", F.array_join("tags", ",").alias("tags"), F.array_join("risk_flags", ",").alias("risk_flags"))


for _name in st.NAMES:
    QUERIES[f"strategy_{_name}"] = lambda s, d, n=_name: show(st.picks(table(s, d), n))
    ORACLE[f"strategy_{_name}"] = oracle.sql(f"SELECT trade_date, market, symbol, candidate_type, score, rank, {oracle.rnd('score / 100', 4)} AS priority_weight, tags, risk_flags FROM p", "xs", extra=f"p AS ({picks_sql(_name)})")

QUERIES["hard_exclusion"] = lambda s, d: table(s, d).select("market", "symbol", "trade_date", st.exclusion(P).alias("reason")).where("reason is not null")
ORACLE["hard_exclusion"] = oracle.sql(f"SELECT * FROM (SELECT market, symbol, trade_date, {REASON} AS reason FROM xs) WHERE reason IS NOT NULL", "xs")
QUERIES["strategy_summary"] = lambda s, d: st.summary(table(s, d), "trend_strength")
_reasons = ["missing_required_factor", "insufficient_liquidity", "overheated_ret_5", "extreme_rsi", "excessive_volatility"]
ORACLE["strategy_summary"] = oracle.sql(
    "SELECT trade_date, count(*) AS universe, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in _reasons) + ", " + ", ".join(f"count(*) FILTER (status = '{r}') AS {r}" for r in ("unclassified_filtered", "low_score_filtered", "picked")) + f" FROM ({scored_sql('trend_strength')}) GROUP BY 1", "xs"
)
QUERIES["strategy_explain"] = lambda s, d: st.explain(table(s, d), "ma_pullback", "sz", "000001").select("trade_date", "market", "symbol", "status", "reason", "candidate_type", "score")
ORACLE["strategy_explain"] = oracle.sql(f"SELECT trade_date, market, symbol, status, reason, candidate_type, score FROM ({scored_sql('ma_pullback')}) WHERE market = 'sz' AND symbol = '000001'", "xs")

POOL = [f"{i:06d}" for i in range(1, 13)]
QUERIES["strategy_pairs"] = lambda s, d: st.pairs(table(s, d), POOL)
ORACLE["strategy_pairs"] = oracle.sql(
    """SELECT market, trade_date, unnest([CASE WHEN z > 0 THEN f ELSE g END, CASE WHEN z > 0 THEN g ELSE f END]) AS symbol, unnest([CASE WHEN z > 0 THEN g ELSE f END, CASE WHEN z > 0 THEN f ELSE g END]) AS peer,
  unnest(['SHORT', 'LONG']) AS direction, unnest([2 * i - 1, 2 * i]) AS rank, z, floor(10 * abs(z) * 100 + 0.5) / 100 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY abs(z) DESC, f, g, market) AS i FROM (SELECT market, trade_date, f, g, n, floor((r - mean) / nullif(sd, 0) * 10000 + 0.5) / 10000 AS z FROM (
    SELECT *, avg(r) OVER w AS mean, stddev_samp(r) OVER w AS sd, count(r) OVER w AS n FROM (SELECT a.market, a.trade_date, a.symbol AS f, b.symbol AS g, a.adj_close / nullif(b.adj_close, 0) AS r FROM tech a JOIN tech b ON a.market = b.market AND a.trade_date = b.trade_date AND a.symbol < b.symbol
      WHERE a.symbol IN """
    + str(tuple(POOL))
    + " AND b.symbol IN "
    + str(tuple(POOL))
    + """) WINDOW w AS (PARTITION BY market, f, g ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))) WHERE n >= 60 AND abs(z) >= 2.0) WHERE i <= 10""",
    "tech",
)

GROUP = ["trend_strength", "low_vol_breakout", "ma_pullback", "relative_strength", "volume_breakout", "multi_factor"]


def group_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.all_picks(table(spark, sf_dir), GROUP)


ALL = "a AS (" + "\nUNION ALL ".join(f"SELECT trade_date, market, symbol, strategy, score, risk_score, risk_flags, amount_ma20, rank FROM ({picks_sql(n)})" for n in GROUP) + ")"
def consensus_sql(avg: str = "floor(cents / n / 100 * 100 + 0.5) / 100", where: str = "hit >= 2", factor: float = 1.0) -> str:
    kinds = "CASE strategy " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in st.KINDS.items()) + " ELSE 'other' END"
    c = f"""c AS (SELECT trade_date, market, symbol, hit, {avg} AS avg_score, {oracle.rnd(f'm * {factor!r}::DOUBLE', 2)} AS max_score, {oracle.rnd('risk', 4)} AS risk_score, strategies,
  CAST(len(list_distinct(list_filter(string_split(fl, ','), lambda x: x <> ''))) AS BIGINT) AS n_flags FROM (SELECT trade_date, market, symbol, count(DISTINCT strategy) AS hit, count(DISTINCT {kinds}) AS kinds, sum(CAST(round(score * 100) AS BIGINT))::DOUBLE AS cents,
  sum(CAST(round(score * 100) AS BIGINT) * CASE strategy WHEN 'trend_strength' THEN 2.0::DOUBLE WHEN 'multi_factor' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weighted, count(score) AS n, max(score) AS m, avg({oracle.rnd('risk_score', 9)}) AS risk,
  string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, string_agg(risk_flags, ',') AS fl FROM a GROUP BY 1, 2, 3) WHERE {where})"""
    return oracle.sql("SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY hit DESC, avg_score DESC, max_score DESC, n_flags, symbol, market) AS rank FROM c", "xs", extra=ALL + ", " + c)


_mean = "floor((cents / n / 100 {}) * 100 + 0.5) / 100"
_decay = max(0.10, 0.5 ** (1 / 5.0))
QUERIES["consensus"] = lambda s, d: st.consensus(group_picks(s, d))
ORACLE["consensus"] = consensus_sql()
QUERIES["consensus_rank_sum"] = lambda s, d: st.consensus(group_picks(s, d), method="rank_sum")
ORACLE["consensus_rank_sum"] = consensus_sql(oracle.rnd(_mean.format("") + " + 5 * ln(hit + 1)", 2))
QUERIES["consensus_weighted"] = lambda s, d: st.consensus(group_picks(s, d), method="weighted_by_performance", weights={"trend_strength": 2.0, "multi_factor": 0.5})
ORACLE["consensus_weighted"] = consensus_sql("floor(weighted / hit / 100 * 100 + 0.5) / 100")
QUERIES["consensus_kinds_decay"] = lambda s, d: st.consensus(group_picks(s, d), different_kinds=True, decay_half_life=5.0)
ORACLE["consensus_kinds_decay"] = consensus_sql(_mean.format(f"* {_decay!r}::DOUBLE"), "hit >= 2 AND kinds >= 2", _decay)
QUERIES["compare"] = lambda s, d: st.compare(group_picks(s, d))
ORACLE["compare"] = oracle.sql(
    f"SELECT g.*, coalesce(n_flags, 0) AS n_flags FROM (SELECT strategy, count(*) AS picks, {oracle.rnd('sum(CAST(round(score * 100) AS BIGINT))::DOUBLE / count(score) / 100', 2)} AS avg_score, {oracle.rnd('max(score)', 2)} AS max_score, count(*) FILTER (score >= 80) AS strong, count(DISTINCT market || symbol) AS symbols FROM a GROUP BY 1) g LEFT JOIN (SELECT strategy, count(DISTINCT f) AS n_flags FROM (SELECT strategy, unnest(string_split(risk_flags, ',')) AS f FROM a WHERE risk_flags <> '') GROUP BY 1) USING (strategy)",
    "xs",
    extra=ALL,
)
QUERIES["overlap"] = lambda s, d: st.overlap(group_picks(s, d))
ORACLE["overlap"] = oracle.sql("SELECT a.strategy, b.strategy AS other, count(*) AS shared FROM a JOIN a b USING (market, symbol, trade_date) WHERE a.strategy < b.strategy GROUP BY 1, 2", "xs", extra=ALL)
PRE = {"basic": {"min_listing_days": 60, "min_price": 20.0, "max_price": 400.0}, "liquidity": {"min_amount_ma20": 100e6}, "risk": {"max_volatility": 0.35, "max_drawdown": 0.15}, "data_quality": {"min_trading_days": 20, "required_fields": ["ret_60", "vol_20"]}}


def pre_filter_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows with the inputs of the pre-filter that daily bars can tell."""
    x = table(s, d)
    return x.withColumns({"close": F.col("adj_close"), "listing_days": F.col("rn"), "trading_days": F.col("rn"), "annual_volatility": F.col("vol_20") * F.sqrt(F.lit(252.0)), "max_drawdown_1y": F.col("dd_60"), "data_quality_insufficient": F.col("atr_pct_14").isNull()})


QUERIES["prefilter"] = lambda s, d: st.pre_filter(pre_filter_rows(s, d), PRE).where(F.size("broken") > 0).select("market", "symbol", "trade_date", F.size("broken").cast("long").alias("n_broken"), F.array_join(F.transform("broken", lambda b: b["rule"]), ",").alias("rules"))
_rules = {"min_listing_days": "rn < 60", "min_price": "adj_close < 20", "max_price": "adj_close > 400", "min_amount_ma20": "amount_ma20 < 100e6", "max_volatility": "vol_20 * sqrt(252.0::DOUBLE) > 0.35", "max_drawdown": "abs(dd_60) > 0.15", "min_trading_days": "rn < 20", "data_quality": "atr_pct_14 IS NULL", "required_fields": "ret_60 IS NULL OR vol_20 IS NULL"}
_broken = joined(*[(y(f"({c})"), r) for r, c in _rules.items()])
ORACLE["prefilter"] = oracle.sql(f"SELECT market, symbol, trade_date, CAST(len(string_split(rules, ',')) AS BIGINT) AS n_broken, rules FROM (SELECT market, symbol, trade_date, {_broken} AS rules FROM xs) WHERE rules <> ''", "xs")
QUERIES["excluded_ranking"] = lambda s, d: st.excluded(table(s, d), "trend_strength").select("trade_date", "market", "symbol", "reason", "score", "place")
ORACLE["excluded_ranking"] = oracle.sql(
    "SELECT * FROM (SELECT trade_date, market, symbol, reason, score, row_number() OVER (PARTITION BY trade_date ORDER BY list_position([" + ", ".join(f"'{r}'" for r in st.REASONS) + f"], reason), score DESC NULLS LAST, amount_ma20 DESC NULLS LAST, market, symbol) AS place FROM ({scored_sql('trend_strength')}) WHERE status = 'excluded') WHERE place <= 20", "xs"
)
QUERIES["label_counts"] = lambda s, d: st.label_counts(st.picks(table(s, d), "trend_strength"))
ORACLE["label_counts"] = oracle.sql(
    "SELECT trade_date, kind, label, count(*) AS n FROM (SELECT trade_date, 'candidate_type' AS kind, candidate_type AS label FROM p UNION ALL SELECT trade_date, 'tag', unnest(string_split(tags, ',')) FROM p WHERE tags <> '' UNION ALL SELECT trade_date, 'risk_flag', unnest(string_split(risk_flags, ',')) FROM p WHERE risk_flags <> '') WHERE label IS NOT NULL GROUP BY 1, 2, 3",
    "xs",
    extra=f"p AS ({picks_sql('trend_strength')})",
)
QUERIES["unique_picks"] = lambda s, d: st.unique_picks(group_picks(s, d))
ORACLE["unique_picks"] = oracle.sql("SELECT strategy, count(*) AS own_picks FROM (SELECT trade_date, market, symbol, min(strategy) AS strategy FROM a GROUP BY 1, 2, 3 HAVING count(DISTINCT strategy) = 1) GROUP BY 1", "xs", extra=ALL)
