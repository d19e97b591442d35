"""Queries over research and risk gates, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle
from ..functions.columns import tie_safe
from ..stored import written
from . import backtest as bt
from . import portfolio as pf
from . import research as rs
from . import risk
from . import strategies as st
from .backtest_queries import BARS, bars, trades_sql
from .factor_queries import all_factors
from .portfolio_queries import BREADTH, PLAN, held
from .portfolio_queries import sql as portfolio_sql
from .strategy_queries import ALL, group_picks, picks_sql, scored_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = lambda e, p=6: oracle.rnd(e, p)
COST = bt.Costs().round_trip
GRID = ([60.0, 75.0], [0.0, 150e6], [2, 5], [5, 10])


def wide(s: SparkSession, d: str, name: str = "trend_strength", top: int = 10) -> DataFrame:
    """Signals, a few rows a day, written as several steps read them."""
    return written(st.picks(table(s, d), name, st.Params(limit=top)).select(F.col("trade_date").alias("signal_date"), "market", "symbol", "rank", "score", "amount_ma20"), "signals")


def wide_sql(name: str = "trend_strength", top: int = 10) -> str:
    return f"SELECT trade_date AS signal_date, market, symbol, rank, score, risk_flags, amount_ma20 FROM ({picks_sql(name)}) WHERE rank <= {top}"


def rated_sql(p: str, key: str) -> str:
    """Steps <p>_o, <p>_f and <p>_r: what rated() makes of periods p by a comma-separated key."""
    on = " AND ".join(f"f.{c.strip()} = o.{c.strip()}" for c in key.split(","))
    own = ", ".join(f"o.{c.strip()}" for c in key.split(","))
    return f"""{p}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY signal_date) AS i FROM {p}),
{p}_f AS (SELECT {key}, i, signal_date, {R('1 + r')} AS e, greatest(1.0::DOUBLE, {R('1 + r')}) AS peak, least(0.0::DOUBLE, {R('1 + r')} / greatest(1.0::DOUBLE, {R('1 + r')}) - 1) AS dd FROM {p}_o WHERE i = 1
  UNION ALL SELECT {own}, o.i, o.signal_date, {R('f.e * (1 + o.r)')}, greatest(f.peak, {R('f.e * (1 + o.r)')}), least(f.dd, {R('f.e * (1 + o.r)')} / greatest(f.peak, {R('f.e * (1 + o.r)')}) - 1) FROM {p}_f f JOIN {p}_o o ON {on} AND o.i = f.i + 1),
{p}_r AS (SELECT *, {R('annual_return - abs(max_drawdown) + 0.1::DOUBLE * win_rate')} AS research_score FROM (SELECT {key}, trades, periods, total_return, {R('CASE WHEN days > 0 THEN pow(1 + total_return, 365.0::DOUBLE / days) - 1 ELSE total_return END')} AS annual_return, max_drawdown, win_rate FROM (
  SELECT {key}, CAST(trades AS BIGINT) AS trades, periods, days, {R('last - 1')} AS total_return, {R('mdd')} AS max_drawdown, {R('won / trades::DOUBLE')} AS win_rate FROM (SELECT {key}, arg_max(e, i) AS last, arg_max(dd, i) AS mdd FROM {p}_f GROUP BY {key})
  JOIN (SELECT {key}, count(*) AS periods, sum(n) AS trades, sum(won) AS won, max(signal_date) - min(signal_date) AS days FROM {p} GROUP BY {key}) USING ({key}))))"""


SCAN_KEY = "min_score, min_amount, top, hold"
SCAN = f"""wsig AS ({wide_sql()}), {BARS}, {trades_sql(5, 'wsig', '5')}, {trades_sql(10, 'wsig', '10')},
spt AS MATERIALIZED (SELECT {SCAN_KEY}, signal_date, sell_date, net FROM (SELECT *, row_number() OVER (PARTITION BY {SCAN_KEY}, signal_date ORDER BY rank) AS place FROM (
  SELECT t.*, amount_ma20 FROM (SELECT CAST(5 AS INT) AS hold, * FROM tr5 UNION ALL SELECT CAST(10 AS INT), * FROM tr10) t JOIN (SELECT signal_date, market, symbol, amount_ma20 FROM wsig) USING (signal_date, market, symbol)),
  (SELECT unnest([60.0::DOUBLE, 75.0::DOUBLE]) AS min_score), (SELECT unnest([0.0::DOUBLE, 150e6::DOUBLE]) AS min_amount), (SELECT CAST(unnest([2, 5]) AS INT) AS top) WHERE score >= min_score AND amount_ma20 >= min_amount) WHERE place <= top AND skipped IS NULL),
sp AS MATERIALIZED (SELECT {SCAN_KEY}, signal_date, {R('avg(net)')} AS r, count(*) AS n, count(*) FILTER (net > 0) AS won FROM spt GROUP BY {SCAN_KEY}, signal_date),
{rated_sql('sp', SCAN_KEY)}"""


def scan_periods(s: SparkSession, d: str) -> DataFrame:
    return bt.scan_periods(wide(s, d), bars(s, d), *GRID)


QUERIES["param_scan"] = lambda s, d: bt.parameter_scan(wide(s, d), bars(s, d), *GRID)
ORACLE["param_scan"] = oracle.sql("SELECT * FROM sp_r", "xs", extra=SCAN)
QUERIES["grid_diagnostics"] = lambda s, d: rs.diagnostics(bt.parameter_scan(wide(s, d), bars(s, d), *GRID), bt.SCAN)
ORACLE["grid_diagnostics"] = oracle.sql(
    """SELECT n, best, median, CASE WHEN median > 0 THEN best > 1.5 * median ELSE best > 0 AND n > 1 END AS isolated_peak, (SELECT count(*) FROM sp_r WHERE abs(research_score - best) <= greatest(abs(best) * 0.1, 0.02)) AS plateau
FROM (SELECT count(*) AS n, max(research_score) AS best, list_sort(list(research_score))[1 + count(*) // 2] AS median FROM sp_r)""",
    "xs", extra=SCAN,
)
QUERIES["walk_forward"] = lambda s, d: rs.walk_forward(bt.scan_trades(wide(s, d), bars(s, d), *GRID), bt.SCAN, 2, 1)


def fold_sql(first: int, n: int) -> str:
    """Periods of the trades that are signalled and closed in years [start + first, start + first + n)."""
    return f"""SELECT start, {SCAN_KEY}, signal_date, {R('avg(net)')} AS r, count(*) AS n, count(*) FILTER (net > 0) AS won FROM spt, st
  WHERE year(signal_date) >= start + {first} AND year(signal_date) < start + {first + n} AND year(sell_date) < start + {first + n} GROUP BY start, {SCAN_KEY}, signal_date"""


ORACLE["walk_forward"] = oracle.sql(
    f"""SELECT start AS phase, {SCAN_KEY}, train_score, signal_date, r, n, {R('e * (now / a)')} AS equity FROM te_f JOIN chain USING (start)""",
    "xs",
    extra=SCAN + f""", st AS (SELECT CAST(unnest(range(lo, hi - 1)) AS INT) AS start FROM (SELECT min(year(signal_date)) AS lo, max(year(signal_date)) AS hi FROM spt)),
tp AS MATERIALIZED ({fold_sql(0, 2)}), {rated_sql("tp", "start, " + SCAN_KEY)},
te AS MATERIALIZED (SELECT t.*, research_score AS train_score, row_number() OVER (PARTITION BY start ORDER BY signal_date) AS i FROM ({fold_sql(2, 1)}) t
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY research_score DESC, {SCAN_KEY}) AS place FROM tp_r) WHERE place = 1) b USING (start, {SCAN_KEY})),
te_f AS (SELECT *, {R('1 + r')} AS e FROM te WHERE i = 1 UNION ALL SELECT t.*, {R('f.e * (1 + t.r)')} FROM te_f f JOIN te t ON t.start = f.start AND t.i = f.i + 1),
phases AS MATERIALIZED (SELECT start, arg_min(e, i) AS a, arg_max(e, i) AS z, row_number() OVER (ORDER BY start) AS p FROM te_f GROUP BY start),
chain AS (SELECT start, p, a, z, 1.0::DOUBLE AS now FROM phases WHERE p = 1 UNION ALL SELECT n.start, n.p, n.a, n.z, {R('c.z * (c.now / c.a)')} FROM chain c JOIN phases n ON n.p = c.p + 1)""",
)
AXES = {"backtest.hold_days": [5, 9], "strategy.min_score": [60.0, 75.0, 99.0]}
CONFIG = {"backtest": {"top": 1}}
_A, _C = bt.Account(), bt.Account().fee + bt.Account().slip
_CFG = ", ".join(f"({i}, {c['backtest']['hold_days']}, {c['strategy']['min_score']}::DOUBLE)" for i, c in enumerate(rs.configurations(CONFIG, AXES)))
_N = f"floor(least({_A.cash}::DOUBLE, cash) / p.buy_price / {_A.lot}) * {_A.lot}"
_KEY = "(p.buy_date, p.rank, p.market, p.symbol)"
RUNS = f"""wsig AS ({wide_sql()}), cfg AS (SELECT * FROM (VALUES {_CFG}) v(g, hold, ms)),
cal AS MATERIALIZED (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM base)),
gs AS (SELECT * FROM (SELECT g, hold, wsig.*, row_number() OVER (PARTITION BY g, signal_date ORDER BY rank, market, symbol) AS k FROM wsig, cfg WHERE score >= ms AND amount_ma20 >= 0) WHERE k = 1),
ent AS MATERIALIZED (SELECT g, hold, s.signal_date, s.market, s.symbol, s.rank, b.trade_date AS buy_date, b.o AS buy_price FROM gs s JOIN cal c ON c.trade_date = s.signal_date JOIN base b ON b.market = s.market AND b.symbol = s.symbol AND b.trade_date = c.next_date WHERE b.is_limit_up = 0 AND b.is_suspended = 0),
lft AS (SELECT e.*, b.trade_date, b.o, CASE WHEN b.o <= buy_price * (1 - {_A.hard_stop}::DOUBLE) OR b.o <= buy_price * (1 - {_A.stop_loss}::DOUBLE) OR b.trade_date - buy_date >= hold THEN 1 END AS why
  FROM ent e JOIN base b ON b.market = e.market AND b.symbol = e.symbol AND b.trade_date > e.buy_date WHERE b.is_limit_down = 0 AND b.is_suspended = 0),
fin AS (SELECT g, signal_date, market, symbol, min(trade_date) AS sell_date, arg_min(o, trade_date) AS sell_price FROM lft WHERE why = 1 GROUP BY ALL),
pos AS MATERIALIZED (SELECT e.*, sell_date, sell_price FROM ent e LEFT JOIN fin USING (g, signal_date, market, symbol)),
w AS (SELECT g, 0 AS i, struct_pack(market := '', symbol := '', buy_date := DATE '1900-01-01', buy_price := 0.0::DOUBLE, sell_date := DATE '1900-01-01', sell_price := 0.0::DOUBLE) AS x, 0.0::DOUBLE AS n, {_A.cash}::DOUBLE AS cash FROM cfg
  UNION ALL SELECT g, i + 1, x, n, cash - n * x.buy_price * (1 + {_C!r}::DOUBLE) + CASE WHEN x.sell_date IS NULL THEN 0.0::DOUBLE ELSE n * x.sell_price * (1 - {_C!r}::DOUBLE) END FROM (
    SELECT w.g, i, cash, arg_min(struct_pack(market := p.market, symbol := p.symbol, buy_date := p.buy_date, buy_price := p.buy_price, sell_date := p.sell_date, sell_price := p.sell_price), {_KEY}) AS x, arg_min({_N}, {_KEY}) AS n
    FROM w JOIN pos p ON p.g = w.g AND p.buy_date >= w.x.sell_date WHERE {_N} >= {_A.lot} AND {_N} * p.buy_price * (1 + {_C!r}::DOUBLE) <= cash GROUP BY w.g, i, cash)),
t AS MATERIALIZED (SELECT g, n, x.market AS market, x.symbol AS symbol, x.buy_date AS buy_date, x.buy_price AS bp, x.sell_date AS sell_date, x.sell_price AS sp FROM (SELECT g, n, x FROM w WHERE i > 0)),
flow AS (SELECT g, d AS trade_date, sum(f) AS f, sum(moved) AS moved FROM (SELECT g, buy_date AS d, -n * bp * (1 + {_C!r}::DOUBLE) AS f, 1 AS moved FROM t UNION ALL SELECT g, sell_date, n * sp * (1 - {_C!r}::DOUBLE), 1 FROM t WHERE sell_date IS NOT NULL) GROUP BY ALL),
val AS (SELECT g, c.trade_date, sum(n * coalesce(b.c, bp)) AS v FROM t JOIN cal c ON c.trade_date >= buy_date AND (sell_date IS NULL OR c.trade_date < sell_date) LEFT JOIN base b ON b.market = t.market AND b.symbol = t.symbol AND b.trade_date = c.trade_date GROUP BY ALL),
day AS (SELECT g, trade_date, moved IS NULL AND v IS NULL AS empty, {R(f'{_A.cash}::DOUBLE + sum(coalesce(f, 0.0::DOUBLE)) OVER (PARTITION BY g ORDER BY trade_date) + coalesce(v, 0.0::DOUBLE)')} AS equity FROM (SELECT g, trade_date FROM cfg, cal) LEFT JOIN flow USING (g, trade_date) LEFT JOIN val USING (g, trade_date)),
ddg AS (SELECT *, equity / greatest({_A.cash}::DOUBLE, max(equity) OVER (PARTITION BY g ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM day),
rated AS MATERIALIZED (SELECT *, {R('annual_return - abs(max_drawdown) + 0.1::DOUBLE * win_rate')} AS research_score FROM (SELECT g, trades, periods, empty, total_return, {R('CASE WHEN days > 0 THEN pow(1 + total_return, 365.0::DOUBLE / days) - 1 ELSE total_return END')} AS annual_return, max_drawdown, win_rate FROM (
  SELECT g, coalesce(trades, 0) AS trades, periods, empty, days, {R(f'last / {_A.cash}::DOUBLE - 1')} AS total_return, {R('least(mdd, 0.0::DOUBLE)')} AS max_drawdown, {R('coalesce(won / nullif(trades, 0)::DOUBLE, 0.0::DOUBLE)')} AS win_rate
  FROM (SELECT g, count(*) AS periods, count(*) FILTER (empty) AS empty, arg_max(equity, trade_date) AS last, min(dd) AS mdd, max(trade_date) - min(trade_date) AS days FROM ddg GROUP BY g)
  LEFT JOIN (SELECT g, count(*) AS trades, count(*) FILTER (round(sp * (1 - {_C!r}::DOUBLE) / (bp * (1 + {_C!r}::DOUBLE)) - 1, 6) > 0) AS won FROM t WHERE sell_date IS NOT NULL GROUP BY g) USING (g))))"""


def runs(s: SparkSession, d: str) -> DataFrame:
    return rs.run_configurations(wide(s, d), all_factors(s, d), rs.configurations(CONFIG, AXES))


QUERIES["account_grid"] = runs
ORACLE["account_grid"] = oracle.sql("SELECT CAST(g AS BIGINT) AS combination, trades, periods, empty, total_return, annual_return, max_drawdown, win_rate, research_score, row_number() OVER (ORDER BY research_score DESC, g) AS place FROM rated", "xs", extra=RUNS)
QUERIES["account_grid_diagnostics"] = lambda s, d: rs.diagnostics(runs(s, d), ["combination"])
ORACLE["account_grid_diagnostics"] = oracle.sql(
    """SELECT n, best, median, CASE WHEN median > 0 THEN best > 1.5 * median ELSE best > 0 AND n > 1 END AS isolated_peak, (SELECT count(*) FROM rated WHERE abs(research_score - best) <= greatest(abs(best) * 0.1, 0.02)) AS plateau
FROM (SELECT count(*) AS n, max(research_score) AS best, list_sort(list(research_score))[1 + count(*) // 2] AS median FROM rated)""",
    "xs", extra=RUNS,
)
SPANS = {"spring_1993": ("1993-03-01", "1993-05-31"), "year_1995": ("1995-01-01", "1995-12-31"), "late": ("1997-01-01", "1998-12-31")}
ONE = "min_score = 60 AND min_amount = 0 AND top = 5 AND hold = 10"
QUERIES["stress_periods"] = lambda s, d: rs.stress(scan_periods(s, d).where(ONE), SPANS)
ORACLE["stress_periods"] = oracle.sql(
    "SELECT * FROM ss_r", "xs",
    extra=SCAN + f", ss AS MATERIALIZED (SELECT period, signal_date, r, n, won FROM sp, (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in SPANS.items())}) v(period, a, b) WHERE {ONE} AND signal_date BETWEEN a AND b), " + rated_sql("ss", "period"),
)
QUERIES["yearly_returns"] = lambda s, d: rs.yearly(scan_periods(s, d), bt.SCAN)
ORACLE["yearly_returns"] = oracle.sql(
    f"SELECT {SCAN_KEY}, year, periods, total_return, annual_return, max_drawdown FROM (SELECT * FROM yp_r)", "xs",
    extra=SCAN + f", yp AS MATERIALIZED (SELECT *, CAST(year(signal_date) AS INT) AS year FROM sp), " + rated_sql("yp", SCAN_KEY + ", year"),
)
NAMES = ["trend_strength", "volume_breakout", "relative_strength"]


def strategy_periods(s: SparkSession, d: str) -> DataFrame:
    daily = bars(s, d)
    out = None
    for n in NAMES:
        t = bt.trades(wide(s, d, n, 5), daily, 10).where("skipped is null").groupBy("signal_date").agg(tie_safe(F.avg("net"), 6).alias("r"), F.count("*").alias("n"), F.count_if(F.col("net") > 0).alias("won")).withColumn("strategy", F.lit(n))
        out = t if out is None else out.union(t)
    return out


QUERIES["compare_backtests"] = lambda s, d: rs.compare_backtests(strategy_periods(s, d))
ORACLE["compare_backtests"] = oracle.sql(
    f"""SELECT cp_r.* EXCLUDE (research_score), avg_period, turnover, row_number() OVER (ORDER BY annual_return DESC, strategy) AS place FROM cp_r JOIN (SELECT strategy, {R('avg(r)')} AS avg_period, {R('sum(n) / count(*)::DOUBLE')} AS turnover FROM cp GROUP BY 1) USING (strategy)""",
    "xs",
    extra=BARS + ", " + ", ".join(f"sg{i} AS ({wide_sql(n, 5)}), {trades_sql(10, f'sg{i}', f'_{i}')}" for i, n in enumerate(NAMES)) + ", cp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, signal_date, {R('avg(net)')} AS r, count(*) AS n, count(*) FILTER (net > 0) AS won FROM tr_{i} WHERE skipped IS NULL GROUP BY 2" for i, n in enumerate(NAMES)) + "), " + rated_sql("cp", "strategy"),
)
CAL = "cal AS MATERIALIZED (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS num FROM (SELECT DISTINCT trade_date FROM base))"
QUERIES["backtest_schedule"] = lambda s, d: rs.schedule(all_factors(s, d), 10)
ORACLE["backtest_schedule"] = oracle.sql("SELECT a.trade_date AS signal_date, CASE WHEN z.trade_date IS NOT NULL THEN b.trade_date END AS buy_date, z.trade_date AS sell_date FROM cal a LEFT JOIN cal b ON b.num = a.num + 1 LEFT JOIN cal z ON z.num = a.num + 11 WHERE (a.num - 1) % 10 = 0", "base", extra=CAL)
QUERIES["next_tradable"] = lambda s, d: (lambda f: rs.next_tradable(f.where("is_limit_down = 1 or is_limit_up = 1").select("market", "symbol", F.date_add("trade_date", 0).alias("wanted_date"), F.when(F.col("is_limit_up") == 1, "SHORT").otherwise("LONG").alias("direction")), f, "wanted_date", F.col("direction")).withColumn("exit_price", tie_safe("exit_price", 6)))(all_factors(s, d))
ORACLE["next_tradable"] = oracle.sql(
    f"""SELECT w.market, w.symbol, w.wanted_date, w.direction, n.trade_date AS exit_date, {R('n.o')} AS exit_price FROM (SELECT market, symbol, trade_date AS wanted_date, CASE WHEN is_limit_up = 1 THEN 'SHORT' ELSE 'LONG' END AS direction FROM base WHERE is_limit_down = 1 OR is_limit_up = 1) w
LEFT JOIN LATERAL (SELECT trade_date, o FROM base b WHERE b.market = w.market AND b.symbol = w.symbol AND b.trade_date >= w.wanted_date AND is_suspended = 0 AND CASE WHEN w.direction = 'SHORT' THEN is_limit_up = 0 ELSE is_limit_down = 0 END ORDER BY trade_date LIMIT 1) n ON true""",
    "base",
)
QUERIES["consensus_backtest"] = lambda s, d: rs.consensus_periods(st.consensus(group_picks(s, d)), all_factors(s, d), 10, 5)
_cons = """cc AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY hit DESC, floor(cents / n + 0.5) / 100 DESC, m DESC, fl, symbol, market) AS rank FROM (SELECT trade_date, market, symbol, count(DISTINCT strategy) AS hit, sum(CAST(round(score * 100) AS BIGINT))::DOUBLE AS cents, count(*) AS n, max(score) AS m,
  len(list_distinct(list_filter(string_split(string_agg(risk_flags, ','), ','), lambda x: x <> ''))) AS fl FROM a GROUP BY 1, 2, 3) WHERE hit >= 2)"""
ORACLE["consensus_backtest"] = oracle.sql(
    f"""SELECT signal_date, coalesce(r, 0.0::DOUBLE) AS r, coalesce(n, 0) AS n, coalesce(won, 0) AS won FROM (SELECT trade_date AS signal_date FROM cal) LEFT JOIN (SELECT signal_date, {R('avg(net)')} AS r, count(*) AS n, count(*) FILTER (net > 0) AS won FROM (
  SELECT d.trade_date AS signal_date, z.o / b.o - 1 - {COST}::DOUBLE AS net FROM cc d JOIN cal c ON c.trade_date = d.trade_date JOIN cal cb ON cb.num = c.num + 1 JOIN cal cz ON cz.num = c.num + 11
  JOIN base b ON b.market = d.market AND b.symbol = d.symbol AND b.trade_date = cb.trade_date JOIN base z ON z.market = d.market AND z.symbol = d.symbol AND z.trade_date = cz.trade_date WHERE rank <= 5) GROUP BY 1) USING (signal_date)""",
    "xs", extra=", ".join([ALL, _cons, CAL]),
)
QUERIES["basket_backtest"] = lambda s, d: rs.basket_periods(held(s, d), all_factors(s, d), 5)
ORACLE["basket_backtest"] = portfolio_sql(
    f"""SELECT signal_date, coalesce(holdings, 0) AS holdings, coalesce(missing, 0) AS missing, {R('coalesce(r, 0)')} AS period_return, {R('coalesce(t, 0)')} AS turnover, {R('exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS equity
FROM du LEFT JOIN (SELECT turn, count(*) AS holdings, count(*) FILTER (NOT coalesce(b > 0 AND z IS NOT NULL, false)) AS missing, coalesce(sum(CASE WHEN b > 0 AND z IS NOT NULL THEN weight * (z / b - 1 - 0.0026::DOUBLE) END), 0) AS r FROM hl GROUP BY 1) USING (turn)
LEFT JOIN (SELECT turn, sum(abs(coalesce(x.weight, 0) - coalesce(y.weight, 0))) / 2 AS t FROM (SELECT turn, market, symbol, weight FROM hl) x FULL JOIN (SELECT turn + 1 AS turn, market, symbol, weight FROM hl) y USING (turn, market, symbol) GROUP BY 1) USING (turn)""",
    CAL,
    """du AS MATERIALIZED (SELECT a.trade_date AS signal_date, (a.num - 1) // 5 AS turn, b.trade_date AS buy_date, z.trade_date AS sell_date FROM cal a JOIN cal b ON b.num = a.num + 1 JOIN cal z ON z.num = least(a.num + 6, (SELECT max(num) FROM cal)) WHERE (a.num - 1) % 5 = 0 AND a.num < (SELECT max(num) FROM cal)),
hl AS MATERIALIZED (SELECT du.turn, w.market, w.symbol, w.weight, b.o AS b, z.o AS z FROM w JOIN du ON du.signal_date = w.trade_date LEFT JOIN base b ON b.market = w.market AND b.symbol = w.symbol AND b.trade_date = du.buy_date LEFT JOIN base z ON z.market = w.market AND z.symbol = w.symbol AND z.trade_date = du.sell_date WHERE w.weight > 0)""",
)
ORDER = [("sh", "999999"), ("sz", "000001"), ("sh", "000003")]
QUERIES["benchmark_by_date"] = lambda s, d: rs.against_benchmark(rs.basket_periods(held(s, d), all_factors(s, d), 5).select("signal_date", "equity"), all_factors(s, d), ORDER).select("signal_date", "benchmark_return")
ORACLE["benchmark_by_date"] = oracle.sql(
    f"SELECT a.trade_date AS signal_date, {R('c / first - 1')} AS benchmark_return FROM cal a LEFT JOIN (SELECT trade_date, c, arg_min(c, trade_date) OVER () AS first FROM base WHERE market = 'sz' AND symbol = '000001') USING (trade_date) WHERE (a.num - 1) % 5 = 0 AND a.num < (SELECT max(num) FROM cal)", "base", extra=CAL
)


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Picks with an invented event: a report on a day of the month that their symbol names."""
    p = st.picks(table(s, d), "multi_factor")
    n = F.col("symbol").cast("int")
    return p.withColumns({"as_of": F.col("trade_date"), "event_type": F.when(n % 3 == 0, "report").when(n % 3 == 1, "unlock"), "event_date": F.date_add(F.trunc("trade_date", "month"), (n % 28).cast("int")), "sector": F.concat(F.lit("s"), (n % 5).cast("string"))})


PICKS = f"ca AS (SELECT *, string_split(risk_flags, ',') AS fl, string_split(tags, ',') AS tg, CASE CAST(symbol AS INT) % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'unlock' END AS event_type, CAST(date_trunc('month', trade_date) AS DATE) + CAST(CAST(symbol AS INT) % 28 AS INT) AS event_date, 's' || (CAST(symbol AS INT) % 5) AS sector FROM ({picks_sql('multi_factor')}))"
QUERIES["risk_intercept"] = lambda s, d: risk.intercept(candidates(s, d), tags=("mild_volatility", "ret_5_strong", "strong_trend"), max_risk=0.03).where("reason is not null").select("trade_date", "market", "symbol", "reason", F.array_join("trigger_tags", ",").alias("trigger_tags"))
ORACLE["risk_intercept"] = oracle.sql(
    """SELECT trade_date, market, symbol, CASE WHEN len(hit) > 0 THEN 'excluded_tag' ELSE 'risk_score' END AS reason, array_to_string(hit, ',') AS trigger_tags FROM (SELECT *, list_filter(['mild_volatility', 'ret_5_strong', 'strong_trend'], lambda x: list_contains(fl, x) OR list_contains(tg, x)) AS hit FROM ca) WHERE len(hit) > 0 OR risk_score > 0.03""",
    "xs", extra=PICKS,
)
QUERIES["event_gate"] = lambda s, d: risk.event_gate(candidates(s, d), {"report": (-3, 5), "unlock": (-10, 0)}, action="reduce_weight").select("trade_date", "market", "symbol", "event_type", "event_date", "event_action", "weight_factor")
ORACLE["event_gate"] = oracle.sql(
    """SELECT trade_date, market, symbol, event_type, event_date, CASE WHEN inside THEN 'reduce_weight' ELSE 'ignore' END AS event_action, CASE WHEN inside THEN 0.5::DOUBLE END AS weight_factor FROM (SELECT *, coalesce(CASE event_type WHEN 'report' THEN trade_date - event_date BETWEEN -3 AND 5 WHEN 'unlock' THEN trade_date - event_date BETWEEN -10 AND 0 END, false) AS inside FROM ca)""",
    "xs", extra=PICKS,
)
QUERIES["risk_control"] = lambda s, d: risk.control(candidates(s, d), ("mild_volatility",), ("s2", "s4")).where("reason is not null").select("trade_date", "market", "symbol", "reason")
ORACLE["risk_control"] = oracle.sql("SELECT trade_date, market, symbol, CASE WHEN list_contains(fl, 'mild_volatility') THEN 'blocked_tag' ELSE 'blocked_sector' END AS reason FROM ca WHERE list_contains(fl, 'mild_volatility') OR sector IN ('s2', 's4')", "xs", extra=PICKS)
QUERIES["risk_scenarios"] = lambda s, d: risk.scenarios(candidates(s, d), 4).select("trade_date", "market", "symbol", F.col("place").cast("long").alias("place"), "scenario_type", "probability", "impact", "trigger")
ORACLE["risk_scenarios"] = oracle.sql(
    """SELECT trade_date, market, symbol, i AS place, x.t AS scenario_type, x.p AS probability, x.i AS impact, x.g AS trigger FROM (SELECT trade_date, market, symbol, unnest(range(1, len(rows) + 1)) AS i, unnest(rows) AS x FROM (SELECT trade_date, market, symbol, list_concat(found, list_transform(range(1, greatest(1, 5 - len(found))), lambda j: {'t': 'macro', 'p': 0.2::DOUBLE, 'i': 'medium', 'g': 'macro'})) AS rows FROM (
  SELECT *, list_filter([{'t': 'technical', 'p': 0.3::DOUBLE, 'i': 'medium', 'g': 'ma20'}, {'t': 'sector', 'p': 0.2::DOUBLE, 'i': 'medium', 'g': 'sector'}, CASE WHEN event_type IS NOT NULL THEN {'t': 'event', 'p': 0.25::DOUBLE, 'i': 'medium', 'g': event_type} END, CASE WHEN risk_flags <> '' THEN {'t': 'technical', 'p': 0.35::DOUBLE, 'i': 'high', 'g': 'risk_flags'} END], lambda y: y IS NOT NULL) AS found FROM ca)))""",
    "xs", extra=PICKS,
)
QUERIES["regime_conditions"] = lambda s, d: risk.market_state(pf.breadth(all_factors(s, d)).withColumnRenamed("breadth", "market_breadth"), ["market_breadth >= 0.55", "n > 50"], ["market_breadth"]).select("trade_date", "market_breadth", "status", "action")
ORACLE["regime_conditions"] = oracle.sql("SELECT trade_date, breadth AS market_breadth, CASE WHEN breadth >= 0.55 AND n > 50 THEN 'bull' ELSE 'bear' END AS status, CASE WHEN breadth >= 0.55 AND n > 50 THEN 'allow_open' ELSE 'pause_open' END AS action FROM br", "base", extra=BREADTH)
QUERIES["rebalance_rejected"] = lambda s, d: (lambda p: risk.reject_costly(p, pf.trade_costs(p, 1e9)).select("trade_date", "market", "symbol", "action", tie_safe("target", 8).alias("target"), tie_safe("delta", 8).alias("delta")))(pf.rebalance(held(s, d)))
ORACLE["rebalance_rejected"] = portfolio_sql(
    f"""SELECT trade_date, market, symbol, CASE WHEN bad THEN 'REJECT_TRADE' ELSE action END AS action, {R('CASE WHEN bad THEN current ELSE target END', 8)} AS target, {R('CASE WHEN bad THEN 0 ELSE delta END', 8)} AS delta FROM (SELECT *, action <> 'HOLD' AND coalesce(abs(delta) * 1e9 / nullif(adv, 0) >= 0.10, false) AS bad FROM pl)""",
    PLAN,
)
QUERIES["rebalance_paused"] = lambda s, d: (lambda x: pf.rebalance(x, paused=F.month("trade_date") == 3))(held(s, d)).select("trade_date", "market", "symbol", "action", tie_safe("target", 8).alias("target"), tie_safe("delta", 8).alias("delta"))
ORACLE["rebalance_paused"] = portfolio_sql(
    f"""SELECT trade_date, market, symbol, CASE WHEN held THEN 'HOLD_CASH' ELSE action END AS action, {R('CASE WHEN held THEN current ELSE target END', 8)} AS target, {R('CASE WHEN held THEN 0 ELSE delta END', 8)} AS delta FROM (SELECT *, month(trade_date) = 3 AND action IN ('BUY', 'INCREASE') AS held FROM pl)""",
    PLAN,
)
# The trimming loop weights anew after each drop: no SQL; tests compare it with a loop.
QUERIES["near_high_trim"] = lambda s, d: pf.trim_near_high(st.picks(table(s, d), "trend_strength").select("trade_date", "market", "symbol", "score", "risk_score", "amount_ma20", "risk_flags"), "liquidity").select("trade_date", "market", "symbol", "weight")
