"""Queries over portfolios, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle
from ..functions.columns import tie_safe
from . import portfolio as pf
from . import strategies as st
from .factor_queries import all_factors
from .strategy_queries import picks_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = lambda e, p=6: oracle.rnd(e, p)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.picks(table(spark, sf_dir), "multi_factor").select("trade_date", "market", "symbol", "score", "risk_score", "amount_ma20", "risk_flags")


def held(spark: SparkSession, sf_dir: str, method: str = "hybrid") -> DataFrame:
    return pf.weights(picks(spark, sf_dir), method)


PICKS = f"pk AS (SELECT trade_date, market, symbol, score, risk_score, amount_ma20, risk_flags, coalesce(score, 0) AS sc, 1 - coalesce(risk_score, 0) AS calm, greatest(coalesce(amount_ma20, 0), 1.0::DOUBLE) AS adv0 FROM ({picks_sql('multi_factor')}))"


def part(e: str) -> str:
    return f"CASE WHEN sum({e}) OVER (PARTITION BY trade_date) > 0 THEN ({e}) / sum({e}) OVER (PARTITION BY trade_date) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) END"


BASES = {"equal": "1.0::DOUBLE", "score": "sc", "risk": "sc * calm", "liquidity": "sc * calm * adv0"}


def weights_sql(method: str) -> str:
    if method == "hybrid":
        v = f"0.4::DOUBLE * {part('sc')} + 0.3::DOUBLE * {part('calm')} + 0.2::DOUBLE * {part('adv0')} + 0.1::DOUBLE * {part('1.0::DOUBLE')}"
        return f"w AS (SELECT *, {part('v')} AS weight FROM (SELECT *, {v} AS v FROM pk))"
    return f"w AS (SELECT *, {part(BASES[method])} AS weight FROM pk)"


def sql(select: str, *more: str, method: str = "hybrid") -> str:
    return oracle.sql(select, "xs", extra=", ".join([PICKS, weights_sql(method), *more]))


for _m in pf.METHODS:
    QUERIES[f"portfolio_weights_{_m}"] = lambda s, d, m=_m: held(s, d, m).select("trade_date", "market", "symbol", tie_safe("weight", 8).alias("weight"))
    ORACLE[f"portfolio_weights_{_m}"] = sql(f"SELECT trade_date, market, symbol, {R('weight', 8)} AS weight FROM w", method=_m)
QUERIES["sector_exposure"] = lambda s, d: pf.exposure(held(s, d))
ORACLE["sector_exposure"] = sql(f"SELECT trade_date, market AS sector, {R('sum(weight)')} AS weight, count(*) AS n, {R("sum(CASE WHEN list_contains(string_split(risk_flags, ','), 'near_20d_high') THEN weight ELSE 0 END)")} AS near_high_weight FROM w GROUP BY 1, 2")
QUERIES["portfolio_risk"] = lambda s, d: pf.risk_check(held(s, d))
ORACLE["portfolio_risk"] = sql(
    f"""SELECT trade_date, n, {R('w')} AS max_weight, {R('m')} AS max_market, CAST(flags AS BIGINT) AS flags, illiquid, violations, warnings, violations = '' AS passed FROM (SELECT *,
  array_to_string(list_filter([CASE WHEN n < 1 THEN 'too_few_holdings' END, CASE WHEN w > 0.1 + 1e-12 THEN 'weight_above_max' END, CASE WHEN keyless > 0 THEN 'missing_key' END], lambda x: x IS NOT NULL), ',') AS violations,
  array_to_string(list_filter([CASE WHEN s <> 0 AND abs(s - 1) > 0.02 THEN 'weights_off_one' END, CASE WHEN m > 0.75 THEN 'market_exposure' END, CASE WHEN flags > 0 THEN 'risk_tags' END, CASE WHEN {R('risk')} > 0.7 THEN 'high_average_risk' END, CASE WHEN illiquid > 0 THEN 'low_liquidity' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT trade_date, count(*) AS n, sum(weight) AS s, max(weight) AS w, sum(CASE WHEN risk_flags = '' THEN 0 ELSE len(string_split(risk_flags, ',')) END) AS flags, avg(risk_score) AS risk, count(*) FILTER (market = '' OR symbol = '') AS keyless,
    count(*) FILTER (CASE WHEN amount_ma20 IS NULL THEN contains(risk_flags, 'risk_factor_missing') ELSE amount_ma20 < 50e6 END) AS illiquid FROM w GROUP BY 1)
  JOIN (SELECT trade_date, max(m) AS m FROM (SELECT trade_date, market, sum(weight) AS m FROM w GROUP BY 1, 2) GROUP BY 1) USING (trade_date))"""
)
PLAN = """dd AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nd FROM (SELECT DISTINCT trade_date FROM w)), cu AS (SELECT nd AS trade_date, market, symbol, weight AS current, amount_ma20 AS a1 FROM w JOIN dd USING (trade_date) WHERE nd IS NOT NULL),
tg AS (SELECT trade_date, market, symbol, weight AS target, amount_ma20 AS a2 FROM w WHERE trade_date IN (SELECT nd FROM dd)),
pl AS (SELECT *, CASE WHEN abs(delta) <= 1e-6 THEN 'HOLD' WHEN current = 0 THEN 'BUY' WHEN target = 0 THEN 'SELL' WHEN delta > 0 THEN 'INCREASE' ELSE 'REDUCE' END AS action FROM (SELECT trade_date, market, symbol, coalesce(current, 0.0::DOUBLE) AS current, coalesce(target, 0.0::DOUBLE) AS target, coalesce(target, 0.0::DOUBLE) - coalesce(current, 0.0::DOUBLE) AS delta, coalesce(a2, a1) AS adv FROM cu FULL JOIN tg USING (trade_date, market, symbol)))"""
QUERIES["rebalance_plan"] = lambda s, d: pf.rebalance(held(s, d)).select("trade_date", "market", "symbol", *[tie_safe(c, 8).alias(c) for c in ("current", "target", "delta")], "action")
ORACLE["rebalance_plan"] = sql(f"SELECT trade_date, market, symbol, {R('current', 8)} AS current, {R('target', 8)} AS target, {R('delta', 8)} AS delta, action FROM pl", PLAN)
QUERIES["rebalance_turnover"] = lambda s, d: pf.turnover(pf.rebalance(held(s, d)))
ORACLE["rebalance_turnover"] = sql(f"SELECT trade_date, orders, {R('t')} AS turnover, {R('t * 50', 4)} AS impact_bps, orders > 50 AS batched FROM (SELECT trade_date, count(*) FILTER (action <> 'HOLD') AS orders, sum(abs(delta)) / 2 AS t FROM pl GROUP BY 1)", PLAN)
QUERIES["trade_cost"] = lambda s, d: pf.trade_costs(pf.rebalance(held(s, d)))
ORACLE["trade_cost"] = sql(f"SELECT trade_date, market, symbol, action, {R('part', 8)} AS adv_share, cost_level, 3.0::DOUBLE + CASE cost_level WHEN 'critical' THEN 50 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END AS cost_bps FROM (SELECT *, CASE WHEN part IS NULL THEN 'unknown' WHEN part >= 0.10 THEN 'critical' WHEN part >= 0.05 THEN 'high' WHEN part >= 0.01 THEN 'medium' ELSE 'low' END AS cost_level FROM (SELECT *, abs(delta) * 1e7 / nullif(adv, 0) AS part FROM pl WHERE action <> 'HOLD'))", PLAN)
QUERIES["order_slices"] = lambda s, d: pf.slices(pf.rebalance(held(s, d)))
ORACLE["order_slices"] = sql(f"SELECT trade_date, market, symbol, action, CAST(unnest([1, 2, 3, 4]) AS INT) AS slice, {R('delta * 1e7 / 4', 2)} AS amount, {R('8 * (1 + 2 * coalesce(abs(delta) * 1e7 / nullif(adv, 0), 0) / 4)', 4)} AS impact_bps FROM pl WHERE action NOT IN ('HOLD', 'HOLD_CASH')", PLAN)
QUERIES["execution_orders"] = lambda s, d: pf.execution_orders(pf.rebalance(held(s, d)), "PoV", 0, piecewise=pf.PIECEWISE, capital=1e9)
_SHARE = "coalesce(abs(delta) * 1e9 / nullif(adv, 0), 0.0::DOUBLE)"
_LEVEL = f"CASE WHEN {_SHARE} >= 0.10 THEN 'critical' WHEN {_SHARE} >= 0.05 THEN 'high' WHEN {_SHARE} >= 0.01 THEN 'medium' ELSE 'low' END"
EXEC = f"""eo AS (SELECT trade_date, market, symbol, action, 'PoV' AS method, CAST(unnest([1, 2, 3, 4, 5, 6]) AS INT) AS slice, {R('delta / 6', 8)} AS delta, {R('share', 8)} AS adv_share, cost_level,
  {R("8 * (1 + 2 * share) + CASE cost_level WHEN 'medium' THEN 5 WHEN 'high' THEN 15 WHEN 'critical' THEN 40 ELSE 0 END", 4)} AS impact_bps, cost_level = 'critical' AS reject
  FROM (SELECT *, {_SHARE} AS share, {_LEVEL} AS cost_level FROM pl WHERE action NOT IN ('HOLD', 'HOLD_CASH')))"""
ORACLE["execution_orders"] = sql("SELECT * FROM eo", PLAN, EXEC)
QUERIES["execution_summary"] = lambda s, d: pf.execution_summary(QUERIES["execution_orders"](s, d))
ORACLE["execution_summary"] = sql(f"SELECT trade_date, count(*) AS slices, count(*) FILTER (reject) AS rejected, ((2 * CAST(sum(CAST(round(impact_bps * 10000) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS impact_bps, count(*) > 1 AS batched FROM eo GROUP BY 1", PLAN, EXEC)
QUERIES["liquidity_status"] = lambda s, d: pf.liquidity(held(s, d), 1e9, 0.1, 3.0)
ORACLE["liquidity_status"] = sql(
    f"""SELECT trade_date, market, symbol, {R('weight', 8)} AS weight, {R('CASE WHEN amount_ma20 > 0 THEN weight * 1e9 END', 2)} AS target_amount, {R('weight * 1e9 / CASE WHEN amount_ma20 > 0 THEN amount_ma20 END', 6)} AS adv_share, {R('days', 4)} AS days_to_sell,
  {R('CASE WHEN amount_ma20 > 0 THEN amount_ma20 * 0.1::DOUBLE * 3 / 1e9 END', 6)} AS weight_cap, CASE WHEN days IS NULL THEN 'no_adv_data' WHEN days <= 3 THEN 'pass' ELSE 'exceeds_liquidation_days' END AS status
FROM (SELECT *, CASE WHEN amount_ma20 > 0 THEN weight * 1e9 / greatest(amount_ma20 * 0.1::DOUBLE, 1.0::DOUBLE) END AS days FROM w)""",
)
QUERIES["market_breadth"] = lambda s, d: pf.breadth(all_factors(s, d))
BREADTH = f"br AS (SELECT trade_date, count(*) AS n, {R('avg(CAST(c > pc AS DOUBLE))')} AS breadth FROM base WHERE pc IS NOT NULL GROUP BY 1)"
ORACLE["market_breadth"] = oracle.sql("SELECT * FROM br", "base", extra=BREADTH)
QUERIES["market_regime"] = lambda s, d: pf.regime(pf.breadth(all_factors(s, d)))
ORACLE["market_regime"] = oracle.sql("SELECT trade_date, breadth, CASE WHEN breadth >= 0.6 THEN 'bull' WHEN breadth <= 0.4 THEN 'bear' ELSE 'neutral' END AS regime, CASE WHEN breadth >= 0.6 THEN 'allow_open' WHEN breadth <= 0.4 THEN 'pause_open' ELSE 'reduce_position' END AS action FROM br", "base", extra=BREADTH)
QUERIES["index_ma_state"] = lambda s, d: pf.index_state(all_factors(s, d), ["000001", "000002"])
ORACLE["index_ma_state"] = oracle.sql(f"SELECT market, symbol, trade_date, {R('c')} AS close, {R('ma20')} AS ma20, {R('ma60')} AS ma60, c > ma20 AND ma20 > ma60 AS trend_up FROM roll WHERE symbol IN ('000001', '000002')", "roll")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pf.risk_check(held(spark, sf_dir)).where("violations <> ''").select("trade_date", F.explode(F.split("violations", ",")).alias("event_type"), F.col("n").cast("string").alias("detail"))
    g = pf.regime(pf.breadth(all_factors(spark, sf_dir))).select("trade_date", F.col("action").alias("event_type"), F.col("regime").alias("detail"))
    return r.unionByName(g)


CHANNELS = ["log", "mail", "desk"]
QUERIES["alerts"] = lambda s, d: pf.alerts(events(s, d), CHANNELS)
ORACLE["alerts"] = sql(
    """SELECT trade_date, event_type, detail, CASE WHEN severe THEN 'warning' ELSE 'info' END AS severity, unnest(CASE WHEN severe THEN ['log', 'mail', 'desk'] ELSE ['log'] END) AS channel FROM (SELECT *, event_type IN ('weight_above_max', 'too_few_holdings', 'pause_open') AS severe FROM (
  SELECT trade_date, 'too_few_holdings' AS event_type, CAST(n AS VARCHAR) AS detail FROM (SELECT trade_date, count(*) AS n, max(weight) AS m FROM w GROUP BY 1) WHERE n < 1
  UNION ALL SELECT trade_date, 'weight_above_max', CAST(n AS VARCHAR) FROM (SELECT trade_date, count(*) AS n, max(weight) AS m FROM w GROUP BY 1) WHERE m > 0.1 + 1e-12
  UNION ALL SELECT trade_date, CASE WHEN breadth >= 0.6 THEN 'allow_open' WHEN breadth <= 0.4 THEN 'pause_open' ELSE 'reduce_position' END, CASE WHEN breadth >= 0.6 THEN 'bull' WHEN breadth <= 0.4 THEN 'bear' ELSE 'neutral' END FROM br))""",
    BREADTH,
)
QUERIES["capped_weights"] = lambda s, d: pf.cap_and_redistribute(held(s, d)).select("trade_date", "market", "symbol", "weight")
