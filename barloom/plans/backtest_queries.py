"""Queries over backtests, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle
from ..functions.columns import tie_safe
from ..stored import written
from . import backtest as bt
from . import strategies as st
from .factor_queries import all_factors
from .strategy_queries import picks_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOP, HOLD, COST = 5, 10, bt.Costs().round_trip
R = lambda e, p=6: oracle.rnd(e, p)


def signals(f: DataFrame, name: str = "trend_strength", top: int = TOP) -> DataFrame:
    return st.picks(f, name, st.Params(limit=top)).select(F.col("trade_date").alias("signal_date"), "market", "symbol", "rank", "score", "risk_flags")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.bars_with_state(all_factors(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals, a few rows a day, written so that what several steps read is picked from all bars once; and bars."""
    return written(signals(table(spark, sf_dir)), "signals"), bars(spark, sf_dir)


def all_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.trades(*parts(spark, sf_dir), HOLD)


SIG = f"sig AS (SELECT trade_date AS signal_date, market, symbol, rank, score, risk_flags FROM ({picks_sql('trend_strength')}) WHERE rank <= {TOP})"
BARS = f"bar AS MATERIALIZED (SELECT market, symbol, trade_date, rn, o, h, c, is_limit_up, is_limit_down, is_suspended, avg(c) {oracle.over(20)} AS m20, avg(h - l) {oracle.over(14)} AS a14 FROM base)"
def trades_sql(hold: int, sig: str = "sig", x: str = "", short: bool = False) -> str:
    """Steps buy, walk, ex and tr, with x after their names, for a table of signals and a holding time."""
    up, down = ("down", "up") if short else ("up", "down")
    early = "" if short else "WHEN c < m20 THEN 'ma_breakdown' WHEN c <= hh - 3.0::DOUBLE * a14 THEN 'atr_chandelier_stop' "
    gross = "buy_price / e.o - 1" if short else "e.o / buy_price - 1"
    return f"""buy{x} AS MATERIALIZED (SELECT s.*, b.rn + 1 AS buy_rn, n.trade_date AS buy_date, n.o AS buy_price, n.is_limit_{up} = 1 OR n.is_suspended = 1 AS blocked FROM {sig} s JOIN bar b ON b.market = s.market AND b.symbol = s.symbol AND b.trade_date = s.signal_date
  LEFT JOIN bar n ON n.market = s.market AND n.symbol = s.symbol AND n.rn = b.rn + 1),
walk{x} AS (SELECT y.market, y.symbol, signal_date, y.buy_rn, b.rn, b.trade_date, b.o, b.c, b.m20, b.a14, max(b.h) OVER (PARTITION BY y.market, y.symbol, signal_date ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hh
  FROM buy{x} y JOIN bar b ON b.market = y.market AND b.symbol = y.symbol AND b.rn > y.buy_rn AND b.rn <= y.buy_rn + {hold} WHERE NOT y.blocked AND b.is_limit_{down} = 0 AND b.is_suspended = 0),
ex{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, signal_date ORDER BY rn) AS k FROM (SELECT *, CASE {early}WHEN rn >= buy_rn + {hold} THEN 'max_holding_days' END AS exit_reason FROM walk{x}) WHERE exit_reason IS NOT NULL) WHERE k = 1),
tr{x} AS (SELECT signal_date, market, symbol, rank, score, buy_date, buy_price, e.trade_date AS sell_date, e.o AS sell_price, exit_reason, CASE WHEN buy_price IS NULL THEN 'missing_price' WHEN blocked THEN 'limit_{up}/suspended' WHEN e.o IS NULL THEN 'missing_price' END AS skipped,
  {gross} AS gross, {gross} - {COST}::DOUBLE AS net FROM buy{x} LEFT JOIN ex{x} e USING (market, symbol, signal_date))"""


TRADES = trades_sql(HOLD)
EQUITY = f"""per AS MATERIALIZED (SELECT signal_date, {R('avg(net)')} AS r, count(*) AS n, row_number() OVER (ORDER BY signal_date) AS i FROM tr WHERE skipped IS NULL GROUP BY 1),
eq AS (SELECT i, signal_date, r, n, {oracle.rnd('1 + r', 6)} AS equity FROM per WHERE i = 1 UNION ALL SELECT p.i, p.signal_date, p.r, p.n, {oracle.rnd('e.equity * (1 + p.r)', 6)} FROM eq e JOIN per p ON p.i = e.i + 1),
ddn AS (SELECT *, {R('equity / peak - 1')} AS drawdown FROM (SELECT *, greatest(1.0::DOUBLE, max(equity) OVER (ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM eq))"""


def sql(select: str, *steps: str, base: tuple[str, ...] = ("xs",)) -> str:
    return oracle.sql(select, *base, extra=", ".join(steps))


def show_trades(t: DataFrame) -> DataFrame:
    return t.select("signal_date", "market", "symbol", "rank", "buy_date", tie_safe("buy_price", 6).alias("buy_price"), "sell_date", tie_safe("sell_price", 6).alias("sell_price"), "exit_reason", "skipped", tie_safe("gross", 6).alias("gross"), tie_safe("net", 6).alias("net"))


QUERIES["next_bar_lateral"] = lambda s, d: (lambda f: signals(table(s, d)).join(f.select("market", "symbol", F.col("trade_date").alias("signal_date"), F.lead("trade_date").over(bt.series()).alias("next_date"), F.lead("o").over(bt.series()).alias("next_open")), ["market", "symbol", "signal_date"], "left").select("signal_date", "market", "symbol", "rank", "next_date", tie_safe("next_open", 6).alias("next_open")))(all_factors(s, d))
ORACLE["next_bar_lateral"] = sql(f"SELECT signal_date, s.market, s.symbol, rank, n.trade_date AS next_date, {R('n.o')} AS next_open FROM sig s LEFT JOIN LATERAL (SELECT trade_date, o FROM bar b WHERE b.market = s.market AND b.symbol = s.symbol AND b.trade_date > s.signal_date ORDER BY trade_date LIMIT 1) n ON true", SIG, BARS)
QUERIES["backtest_match"] = lambda s, d: show_trades(all_trades(s, d))
ORACLE["backtest_match"] = sql(f"SELECT signal_date, market, symbol, rank, buy_date, {R('buy_price')} AS buy_price, sell_date, {R('sell_price')} AS sell_price, exit_reason, skipped, {R('gross')} AS gross, {R('net')} AS net FROM tr", SIG, BARS, TRADES)
QUERIES["backtest_match_sides"] = lambda s, d: (lambda sig, bars: show_trades(bt.trades(sig.withColumn("direction", F.when(F.col("rank") % 2 == 0, "SHORT")), bars, HOLD)))(*parts(s, d))
ORACLE["backtest_match_sides"] = sql(
    " UNION ALL ".join(f"SELECT signal_date, market, symbol, rank, buy_date, {R('buy_price')} AS buy_price, sell_date, {R('sell_price')} AS sell_price, exit_reason, skipped, {R('gross')} AS gross, {R('net')} AS net FROM tr{n}" for n in ("l", "s")),
    SIG, BARS, "sigl AS (SELECT * FROM sig WHERE rank % 2 = 1), sigs AS (SELECT * FROM sig WHERE rank % 2 = 0)", trades_sql(HOLD, "sigl", "l"), trades_sql(HOLD, "sigs", "s", short=True),
)
QUERIES["backtest_trades"] = lambda s, d: all_trades(s, d).groupBy(F.coalesce("skipped", "exit_reason").alias("outcome")).agg(F.count("*").alias("n"), tie_safe(F.avg("net"), 6).alias("avg_net"))
ORACLE["backtest_trades"] = sql(f"SELECT coalesce(skipped, exit_reason) AS outcome, count(*) AS n, {R('avg(net)')} AS avg_net FROM tr GROUP BY 1", SIG, BARS, TRADES)
QUERIES["backtest_equity"] = lambda s, d: bt.equity(bt.periods(all_trades(s, d)))
ORACLE["backtest_equity"] = sql("SELECT signal_date, r, n, equity FROM eq", SIG, BARS, TRADES, EQUITY)
QUERIES["max_drawdown"] = lambda s, d: bt.drawdown(bt.equity(bt.periods(all_trades(s, d)))).select("signal_date", "equity", "peak", "drawdown")
ORACLE["max_drawdown"] = sql("SELECT signal_date, equity, peak, drawdown FROM ddn", SIG, BARS, TRADES, EQUITY)
QUERIES["backtest_summary"] = lambda s, d: (lambda t: bt.summary(t, bt.equity(bt.periods(t))))(all_trades(s, d))
ORACLE["backtest_summary"] = sql(
    f"""SELECT trades, periods, win_rate, avg_period, best, worst, {oracle.rnd('last - 1', 6)} AS total_return, {R('CASE WHEN days > 0 THEN pow(last, 365.0::DOUBLE / days) - 1 ELSE last - 1 END', 4)} AS annual_return, least(dd, 0.0::DOUBLE) AS max_drawdown, {R('trades / periods::DOUBLE')} AS turnover
FROM (SELECT count(*) AS trades, {R('avg(CAST(net > 0 AS DOUBLE))')} AS win_rate FROM tr WHERE skipped IS NULL), (SELECT count(*) AS periods, arg_max(equity, signal_date) AS last, min(drawdown) AS dd, {R('avg(r)')} AS avg_period, max(r) AS best, min(r) AS worst, max(signal_date) - min(signal_date) AS days FROM ddn)""",
    SIG, BARS, TRADES, EQUITY,
)

HORIZONS = [1, 5, 10, 20]
FWD = "path AS (SELECT market, symbol, trade_date AS signal_date, lead(o, 1) OVER w AS buy, " + ", ".join(f"lead(o, {1 + h}) OVER w AS s{h}, min(o) OVER (PARTITION BY market, symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {1 + h} FOLLOWING) AS l{h}" for h in HORIZONS) + " FROM base WINDOW w AS (PARTITION BY market, symbol ORDER BY trade_date)), fw AS (" + " UNION ALL ".join(f"SELECT sig.*, {h} AS horizon, {R(f's{h} / buy - 1')} AS ret, {R(f'l{h} / buy - 1')} AS low FROM sig JOIN path USING (market, symbol, signal_date) WHERE s{h} IS NOT NULL" for h in HORIZONS) + ")"
QUERIES["forward_returns"] = lambda s, d: bt.forward_stats(bt.forward(signals(table(s, d)), all_factors(s, d), HORIZONS))
ORACLE["forward_returns"] = sql(f"SELECT CAST(horizon AS INT) AS horizon, count(*) AS n, {R('avg(ret)')} AS mean, {R('quantile_cont(ret, 0.5)')} AS median, {R('avg(CAST(ret > 0 AS DOUBLE))')} AS win_rate, {R('list_sort(list(ret))[1 + CAST(round_even((count(*) - 1) * 0.25, 0) AS INT)]')} AS p25, {R('list_sort(list(ret))[1 + CAST(round_even((count(*) - 1) * 0.75, 0) AS INT)]')} AS p75, max(ret) AS best, min(ret) AS worst FROM fw GROUP BY 1", SIG, FWD)
QUERIES["risk_tags"] = lambda s, d: bt.risk_tags(bt.forward(signals(table(s, d)), all_factors(s, d), HORIZONS))
ORACLE["risk_tags"] = sql(f"SELECT tag, CAST(horizon AS INT) AS horizon, count(*) AS n, {R('avg(ret)')} AS mean, {R('avg(CAST(ret > 0 AS DOUBLE))')} AS win_rate, min(ret) AS worst, min(low) AS min_drawdown FROM (SELECT *, unnest(string_split(risk_flags, ',')) AS tag FROM fw WHERE risk_flags <> '') GROUP BY 1, 2", SIG, FWD)
QUERIES["winsorized"] = lambda s, d: bt.winsorized(all_factors(s, d))
ORACLE["winsorized"] = oracle.sql(f"SELECT market, symbol, max(n) AS n, CASE WHEN max(n) >= 3 THEN {R('exp(sum(ln(1 + pct_chg))) - 1')} END AS ret FROM (SELECT *, CASE WHEN n >= 20 AND floor(n * 0.01) = 0 THEN 1 ELSE floor(n * 0.01) END AS cut FROM (SELECT *, count(*) OVER (PARTITION BY market, symbol) AS n, row_number() OVER (PARTITION BY market, symbol ORDER BY pct_chg, trade_date) AS i FROM base WHERE pct_chg IS NOT NULL)) WHERE i > cut AND i <= n - cut GROUP BY 1, 2", "base")
QUERIES["benchmark_return"] = lambda s, d: bt.benchmark(all_factors(s, d), "sz", "000001")
ORACLE["benchmark_return"] = oracle.sql(f"SELECT market, symbol, count(*) AS n, {R('arg_max(c, trade_date) / arg_min(c, trade_date) - 1')} AS ret FROM base WHERE market = 'sz' AND symbol = '000001' GROUP BY 1, 2 HAVING count(*) >= 2", "base")
QUERIES["monthly_returns"] = lambda s, d: bt.monthly_returns(all_factors(s, d))
ORACLE["monthly_returns"] = oracle.sql(f"SELECT market, symbol, month, {R('c')} AS close, {R('c / nullif(lag(c) OVER (PARTITION BY market, symbol ORDER BY month), 0) - 1')} AS ret FROM (SELECT market, symbol, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(c, trade_date) AS c FROM base GROUP BY 1, 2, 3)", "base")
# Walks through time or random draws: no SQL, but for an account of one position.
def accounts(s: SparkSession, d: str) -> DataFrame:
    """Three accounts' signals: one buys, one also sells every second pick of a day short, one takes the first pick alone."""
    sig, _ = parts(s, d)
    side = F.when((F.col("account") == "hedged") & (F.col("rank") % 2 == 0), "SHORT").otherwise("LONG")
    return sig.withColumn("account", F.explode(F.array(F.lit("long"), F.lit("hedged"), F.lit("first")))).where((F.col("account") != "first") | (F.col("rank") == 1)).withColumn("direction", side)


RULES = bt.Account(chandelier=3.0, trailing=0.08, stop_loss=0.07, take_profit=0.2, hold_days=30)
QUERIES["stateful_simulation"] = lambda s, d: bt.simulate(accounts(s, d), all_factors(s, d), RULES)
QUERIES["stateful_equity"] = lambda s, d: (lambda f: bt.marked_equity(written(bt.simulate(accounts(s, d), f, RULES), "trades"), f, RULES))(all_factors(s, d))
QUERIES["stateful_periods"] = lambda s, d: (lambda f: bt.account_periods(written(bt.ledger(accounts(s, d), f, RULES), "ledger"), f, RULES))(all_factors(s, d))
ALONE = bt.Account(max_positions=1)
QUERIES["stateful_single"] = lambda s, d: bt.simulate(parts(s, d)[0], all_factors(s, d), ALONE).select("market", "symbol", "signal_date", "buy_date", "sell_date", "shares", tie_safe("buy_price", 6).alias("buy_price"), tie_safe("sell_price", 6).alias("sell_price"), "net", "exit_reason")
_COST = ALONE.fee + ALONE.slip
ORACLE["stateful_single"] = sql(
    f"""SELECT x.market, x.symbol, x.signal_date, x.buy_date, x.sell_date, CAST(n AS BIGINT) AS shares, {R('x.buy_price')} AS buy_price, {R('x.sell_price')} AS sell_price, round(x.sell_price * (1 - {_COST!r}::DOUBLE) / (x.buy_price * (1 + {_COST!r}::DOUBLE)) - 1, 6) AS net, x.exit_reason FROM (SELECT i, x, n FROM w WHERE i > 0)""",
    SIG,
    f"""cal AS MATERIALIZED (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM base)),
ent AS MATERIALIZED (SELECT s.signal_date, s.market, s.symbol, s.rank, b.trade_date AS buy_date, b.o AS buy_price FROM sig s JOIN cal c ON c.trade_date = s.signal_date JOIN base b ON b.market = s.market AND b.symbol = s.symbol AND b.trade_date = c.next_date WHERE b.is_limit_up = 0 AND b.is_suspended = 0),
lft AS (SELECT e.*, b.trade_date, b.o, CASE WHEN b.o <= buy_price * (1 - {ALONE.hard_stop}::DOUBLE) THEN 'hard_stop_loss' WHEN b.o <= buy_price * (1 - {ALONE.stop_loss}::DOUBLE) THEN 'stop_loss' WHEN b.trade_date - buy_date >= {ALONE.hold_days} THEN 'hold_days' END AS why
  FROM ent e JOIN base b ON b.market = e.market AND b.symbol = e.symbol AND b.trade_date > e.buy_date WHERE b.is_limit_down = 0 AND b.is_suspended = 0),
fin AS (SELECT signal_date, market, symbol, min(trade_date) AS sell_date, arg_min(o, trade_date) AS sell_price, arg_min(why, trade_date) AS exit_reason FROM lft WHERE why IS NOT NULL GROUP BY ALL),
pos AS MATERIALIZED (SELECT e.*, sell_date, sell_price, exit_reason FROM ent e LEFT JOIN fin USING (signal_date, market, symbol)),
w AS (SELECT 0 AS i, struct_pack(signal_date := DATE '1900-01-01', market := '', symbol := '', rank := 0::BIGINT, buy_date := DATE '1900-01-01', buy_price := 0.0::DOUBLE, sell_date := DATE '1900-01-01', sell_price := 0.0::DOUBLE, exit_reason := '') AS x, 0.0::DOUBLE AS n, {ALONE.cash}::DOUBLE AS cash
  UNION ALL SELECT i + 1, x, n, cash - n * x.buy_price * (1 + {_COST!r}::DOUBLE) + CASE WHEN x.sell_date IS NULL THEN 0.0::DOUBLE ELSE n * x.sell_price * (1 - {_COST!r}::DOUBLE) END FROM (
    SELECT i, cash, arg_min(struct_pack(signal_date := p.signal_date, market := p.market, symbol := p.symbol, rank := CAST(p.rank AS BIGINT), buy_date := p.buy_date, buy_price := p.buy_price, sell_date := p.sell_date, sell_price := p.sell_price, exit_reason := p.exit_reason), (p.buy_date, p.rank, p.market, p.symbol)) AS x,
      arg_min(floor(least({ALONE.cash}::DOUBLE, cash) / p.buy_price / {ALONE.lot}) * {ALONE.lot}, (p.buy_date, p.rank, p.market, p.symbol)) AS n
    FROM w JOIN pos p ON p.buy_date >= w.x.sell_date WHERE floor(least({ALONE.cash}::DOUBLE, cash) / p.buy_price / {ALONE.lot}) >= 1 AND floor(least({ALONE.cash}::DOUBLE, cash) / p.buy_price / {ALONE.lot}) * {ALONE.lot} * p.buy_price * (1 + {_COST!r}::DOUBLE) <= cash GROUP BY i, cash))""",
)
QUERIES["monte_carlo"] = lambda s, d: bt.monte_carlo(s, [r["r"] for r in bt.periods(all_trades(s, d)).orderBy("signal_date").collect()], 2000)
