"""Backtests as set operations: all signals meet all bars in joins; only the shared-cash simulation walks days one by one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import frame, series, tie_safe
from .accounts import Account, account_of, account_periods, bars_of, ledger, marked_equity, outcomes, shares, simulate  # noqa: F401  (one name for all of a backtest)

k = F.col


@dataclass(frozen=True)
class Costs:
    fee: float = 0.0003
    slip: float = 0.001

    @property
    def round_trip(self) -> float:
        return 2 * (self.fee + self.slip)


def bars_with_state(f: DataFrame) -> DataFrame:
    """Bars by number with what exits look at: 20-bar mean close, 14-bar mean range, tradability."""
    return f.select("market", "symbol", "trade_date", "rn", "o", "h", "l", "c", "is_limit_up", "is_limit_down", "is_suspended", F.avg("c").over(frame(20)).alias("m20"), F.avg(k("h") - k("l")).over(frame(14)).alias("a14"))


def trades_by_hold(signals: DataFrame, bars: DataFrame, holds: list[int], chandelier: float = 3.0, costs: Costs = Costs()) -> DataFrame:
    """One row a signal (signal_date, market, symbol, rank, score) and holding time: bought at the next bar's open, sold at the first trigger's.

    Each signal is joined with as many of its next bars, by number, as the longest holding time has, an equi-join; bars on
    which a sale is blocked are passed over. The exit is at the open of the first bar that closes under its mean, falls
    `chandelier` mean ranges under the highest high since the purchase, or ends the holding time. All holding times are
    aggregates of one walk, and only instruments with signals are walked. Signals whose column direction says SHORT are sold first and bought back: they open on bars
    that are not at the lower limit, close on ones that are not at the upper, and only for the holding time.
    """
    side = F.when(F.upper("direction") == "SHORT", "SHORT").otherwise("LONG") if "direction" in signals.columns else F.lit("LONG")
    signals = signals.withColumn("direction", side)
    bars = bars_of(signals, bars)
    key = ["market", "symbol", "signal_date", "direction"]
    short = k("direction") == "SHORT"
    closed = lambda up, down: (k("is_suspended") == 1) | F.when(short, k(down) == 1).otherwise(k(up) == 1)
    at = signals.join(bars.select("market", "symbol", k("trade_date").alias("signal_date"), "rn"), key[:3])
    first = bars.select("market", "symbol", k("rn").alias("buy_rn"), k("trade_date").alias("buy_date"), k("o").alias("buy_price"), "is_limit_up", "is_limit_down", "is_suspended")
    buy = at.withColumn("buy_rn", k("rn") + 1).join(first, ["market", "symbol", "buy_rn"], "left").withColumn("buy_blocked", closed("is_limit_up", "is_limit_down")).drop("rn", "is_limit_up", "is_limit_down", "is_suspended")
    days = buy.where(~k("buy_blocked")).select(*key, "buy_rn", F.explode(F.sequence(k("buy_rn") + 1, k("buy_rn") + max(holds))).alias("rn"))
    walk = days.join(bars, ["market", "symbol", "rn"]).where(~closed("is_limit_down", "is_limit_up"))
    walk = walk.withColumn("hh", F.max("h").over(Window.partitionBy(*key).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    early = F.when(short, F.lit(None).cast("string")).when(k("c") < k("m20"), "ma_breakdown").when(k("c") <= k("hh") - chandelier * k("a14"), "atr_chandelier_stop")
    left = walk.withColumn("early", early).withColumn("x", F.struct("trade_date", "o", F.coalesce("early", F.lit("max_holding_days")).alias("exit_reason")))
    ends = lambda n: (k("rn") <= k("buy_rn") + n) & (k("early").isNotNull() | (k("rn") == k("buy_rn") + n))
    each = F.array(*[F.struct(F.lit(n).alias("hold"), F.min_by("x", F.when(ends(n), k("rn"))).alias("x")) for n in holds])
    exits = left.groupBy(*key).agg(each.alias("e")).select(*key, F.explode("e").alias("e")).select(*key, "e.*")
    out = buy.withColumn("hold", F.explode(F.array(*[F.lit(n) for n in holds]))).join(exits, [*key, "hold"], "left")
    gross = F.when(short, F.try_divide(k("buy_price"), k("x.o"))).otherwise(F.try_divide(k("x.o"), k("buy_price"))) - 1
    skip = F.when(k("buy_price").isNull(), "missing_price").when(k("buy_blocked"), F.when(short, "limit_down/suspended").otherwise("limit_up/suspended")).when(k("x.o").isNull(), "missing_price")
    return out.select("hold", "signal_date", "market", "symbol", "rank", "score", "buy_date", "buy_price", k("x.trade_date").alias("sell_date"), k("x.o").alias("sell_price"), k("x.exit_reason").alias("exit_reason"), skip.alias("skipped"), gross.alias("gross"), (gross - costs.round_trip).alias("net"), "direction")


def trades(signals: DataFrame, bars: DataFrame, hold: int = 10, chandelier: float = 3.0, costs: Costs = Costs()) -> DataFrame:
    """:func:`trades_by_hold` of one holding time."""
    return trades_by_hold(signals, bars, [hold], chandelier, costs).drop("hold")


def periods(t: DataFrame) -> DataFrame:
    """Mean net return of each signal date that traded, six places."""
    return t.where("skipped is null").groupBy("signal_date").agg(tie_safe(F.avg("net"), 6).alias("r"), F.count("*").alias("n"))


def equity(p: DataFrame) -> DataFrame:
    """Compounded equity after each period, rounded to six places at every step.

    The rounded recursion is one path over periods, of which a backtest has as many as days: one group of (date, return)
    rows, read once in order. Bars and trades stay distributed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = 1.0
        for b in batches:
            out = np.empty(len(b))
            for i, r in enumerate(b["r"].to_numpy()):
                e = out[i] = np.floor(e * (1 + r) * 1e6 + 0.5) / 1e6
            yield b.assign(equity=out)

    ordered = p.select("signal_date", "r", "n").repartition(1).sortWithinPartitions("signal_date")
    return ordered.mapInPandas(run, "signal_date date, r double, n long, equity double")


def drawdown(curve: DataFrame, by: str = "signal_date") -> DataFrame:
    """curve (equity) with its running peak, started at 1, and the drawdown from it."""
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("drawdown", tie_safe(k("equity") / k("peak") - 1, 6))


def summary(t: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: trades, winners, mean, best and worst period, total and annual return, deepest drawdown, turnover."""
    a = t.where("skipped is null").agg(F.count("*").alias("trades"), tie_safe(F.avg((k("net") > 0).cast("double")), 6).alias("win_rate"))
    c = drawdown(curve).agg(F.count("*").alias("periods"), F.max_by("equity", "signal_date").alias("last"), F.min("drawdown").alias("max_drawdown"), tie_safe(F.avg("r"), 6).alias("avg_period"), F.max("r").alias("best"), F.min("r").alias("worst"), F.datediff(F.max("signal_date"), F.min("signal_date")).alias("days"))
    total = k("last") - 1
    return a.crossJoin(c).select("trades", "periods", "win_rate", "avg_period", "best", "worst", tie_safe(total, 6).alias("total_return"), tie_safe(F.when(k("days") > 0, F.pow(k("last"), F.lit(365.0) / k("days")) - 1).otherwise(total), 4).alias("annual_return"), F.least("max_drawdown", F.lit(0.0)).alias("max_drawdown"), tie_safe(F.try_divide(k("trades").cast("double"), k("periods")), 6).alias("turnover"))


def forward(signals: DataFrame, f: DataFrame, horizons: list[int]) -> DataFrame:
    """(horizon, ret, drawdown) of every signal, from the next bar's open to the open `horizon` bars later."""
    nxt = {h: F.lead("o", 1 + h).over(series()) for h in horizons}
    low = {h: F.min("o").over(series().rowsBetween(1, 1 + h)) for h in horizons}
    path = f.select("market", "symbol", k("trade_date").alias("signal_date"), F.lead("o", 1).over(series()).alias("buy"), *[c.alias(f"s{h}") for h, c in nxt.items()], *[c.alias(f"l{h}") for h, c in low.items()])
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), tie_safe(F.try_divide(k(f"s{h}"), k("buy")) - 1, 6).alias("ret"), tie_safe(F.try_divide(k(f"l{h}"), k("buy")) - 1, 6).alias("low")) for h in horizons])
    return signals.join(path, ["market", "symbol", "signal_date"]).select(*signals.columns, F.explode(rows).alias("x")).select(*signals.columns, "x.*").where("ret is not null")


def forward_stats(fw: DataFrame) -> DataFrame:
    """By horizon: n, mean, median, winners, nearest-rank quartiles, best, worst.

    Returns have six places, so a horizon has few distinct ones: a quartile is found in running counts by return.
    """
    counts = fw.groupBy("horizon", "ret").agg(F.count("*").alias("m"))
    by = Window.partitionBy("horizon")
    run = counts.withColumns({"upto": F.sum("m").over(by.orderBy("ret")), "n": F.sum("m").over(by)})
    # The place round((n - 1) q), halves to even, from 0 on.
    at = lambda q: F.min(F.when(k("upto") > F.bround((k("n") - 1) * q, 0), k("ret")))
    near = run.groupBy("horizon").agg(at(0.25).alias("p25"), at(0.75).alias("p75"))
    rest = fw.groupBy("horizon").agg(F.count("*").alias("n"), tie_safe(F.avg("ret"), 6).alias("mean"), tie_safe(F.percentile("ret", 0.5), 6).alias("median"), tie_safe(F.avg((k("ret") > 0).cast("double")), 6).alias("win_rate"), F.max("ret").alias("best"), F.min("ret").alias("worst"))
    return rest.join(near, "horizon").select("horizon", "n", "mean", "median", "win_rate", "p25", "p75", "best", "worst")


def risk_tags(fw: DataFrame) -> DataFrame:
    """By risk flag and horizon: n, mean, winners, worst return, deepest low."""
    return fw.withColumn("tag", F.explode("risk_flags")).groupBy("tag", "horizon").agg(F.count("*").alias("n"), tie_safe(F.avg("ret"), 6).alias("mean"), tie_safe(F.avg((k("ret") > 0).cast("double")), 6).alias("win_rate"), F.min("ret").alias("worst"), F.min("low").alias("min_drawdown"))


def folded(p: DataFrame, key: list[str]) -> DataFrame:
    """By key: last equity (from 1, six places at every step) and deepest drawdown of the periods (signal_date, r).

    A group is one path: as many (date, return) pairs as days.
    """
    path = F.array_sort(F.collect_list(F.struct("signal_date", "r")))

    def step(acc: Column, x: Column) -> Column:
        e = tie_safe(acc["e"] * (1 + x["r"]), 6)
        peak = F.greatest(acc["peak"], e)
        return F.struct(e.alias("e"), peak.alias("peak"), F.least(acc["dd"], e / peak - 1).alias("dd"))

    start = F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"))
    ends = p.groupBy(*key).agg(path.alias("path"), F.count("*").alias("periods"), F.datediff(F.max("signal_date"), F.min("signal_date")).alias("days"))
    return ends.withColumn("x", F.aggregate("path", start, step)).select(*key, "periods", "days", k("x.e").alias("last"), tie_safe("x.dd", 6).alias("max_drawdown"))


def annual(total: Column, days: Column) -> Column:
    return F.when(days > 0, F.pow(1 + total, F.lit(365.0) / days) - 1).otherwise(total)


SCAN = ["min_score", "min_amount", "top", "hold"]


def scan_trades(signals: DataFrame, bars: DataFrame, min_scores: list[float], amounts: list[float], tops: list[int], holds: list[int], costs: Costs = Costs()) -> DataFrame:
    """(min_score, min_amount, top, hold, signal_date, sell_date, net) of every combination's trades, from one matching for all.

    signals are the widest ones, with score and amount_ma20; each combination takes its first `top` of those it admits.
    """
    every = trades_by_hold(signals, bars, holds, costs=costs)
    amount = signals.select("signal_date", "market", "symbol", "amount_ma20")
    grid = F.array(*[F.struct(F.lit(float(s)).alias("min_score"), F.lit(float(a)).alias("min_amount"), F.lit(t).alias("top")) for s in min_scores for a in amounts for t in tops])
    x = every.join(amount, ["signal_date", "market", "symbol"]).withColumn("g", F.explode(grid)).where((k("score") >= k("g.min_score")) & (k("amount_ma20") >= k("g.min_amount")))
    x = x.select("g.*", "hold", "signal_date", "sell_date", "rank", "skipped", "net")
    first = Window.partitionBy(*SCAN, "signal_date").orderBy("rank")
    return x.withColumn("place", F.row_number().over(first)).where((k("place") <= k("top")) & k("skipped").isNull()).select(*SCAN, "signal_date", "sell_date", "net")


def periods_of(t: DataFrame, key: list[str]) -> DataFrame:
    """(key, signal_date, r, n, won): mean net return, trades and winners of each signal date."""
    return t.groupBy(*key, "signal_date").agg(tie_safe(F.avg("net"), 6).alias("r"), F.count("*").alias("n"), F.count_if(k("net") > 0).alias("won"))


def scan_periods(signals: DataFrame, bars: DataFrame, min_scores: list[float], amounts: list[float], tops: list[int], holds: list[int], costs: Costs = Costs()) -> DataFrame:
    """(min_score, min_amount, top, hold, signal_date, r, n, won) of every combination."""
    return periods_of(scan_trades(signals, bars, min_scores, amounts, tops, holds, costs), SCAN)


def rated(p: DataFrame, key: list[str]) -> DataFrame:
    """By key: trades, periods, returns, drawdown, winners, and research score = annual return - |drawdown| + winners / 10, best first."""
    counts = p.groupBy(*key).agg(F.sum("n").alias("trades"), F.sum("won").alias("won"))
    x = folded(p, key).join(counts, key).withColumn("total_return", tie_safe(k("last") - 1, 6))
    x = x.withColumns({"annual_return": tie_safe(annual(k("total_return"), k("days")), 6), "win_rate": tie_safe(k("won") / k("trades"), 6)})
    return x.select(*key, "trades", "periods", "total_return", "annual_return", "max_drawdown", "win_rate", tie_safe(k("annual_return") - F.abs("max_drawdown") + 0.1 * k("win_rate"), 6).alias("research_score"))


def parameter_scan(signals: DataFrame, bars: DataFrame, min_scores: list[float], amounts: list[float], tops: list[int], holds: list[int], costs: Costs = Costs()) -> DataFrame:
    return rated(scan_periods(signals, bars, min_scores, amounts, tops, holds, costs), SCAN)


def winsorized(f: DataFrame) -> DataFrame:
    """By series: bars' returns compounded without the hundredth at either end (one bar at least from 20 bars on)."""
    w = Window.partitionBy("market", "symbol")
    x = f.where("pct_chg is not null").select("market", "symbol", "trade_date", "pct_chg").withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("pct_chg", "trade_date"))})
    trim = F.floor(k("n") * 0.01)
    cut = F.when((k("n") >= 20) & (trim == 0), 1).otherwise(trim)
    return x.where((k("i") > cut) & (k("i") <= k("n") - cut)).groupBy("market", "symbol").agg(F.max("n").alias("n"), F.sum(F.log1p("pct_chg")).alias("s")).select("market", "symbol", "n", F.when(k("n") >= 3, tie_safe(F.exp("s") - 1, 6)).alias("ret"))


def benchmark(f: DataFrame, market: str, symbol: str) -> DataFrame:
    x = f.where((k("market") == market) & (k("symbol") == symbol)).groupBy("market", "symbol").agg(F.count("*").alias("n"), F.min_by("c", "trade_date").alias("a"), F.max_by("c", "trade_date").alias("z"))
    return x.where("n >= 2").select("market", "symbol", "n", tie_safe(F.try_divide("z", "a") - 1, 6).alias("ret"))


def monthly_returns(f: DataFrame) -> DataFrame:
    m = f.groupBy("market", "symbol", F.date_trunc("month", "trade_date").cast("date").alias("month")).agg(F.max_by("c", "trade_date").alias("c"))
    w = Window.partitionBy("market", "symbol").orderBy("month")
    return m.select("market", "symbol", "month", tie_safe("c", 6).alias("close"), tie_safe(F.try_divide(k("c"), F.lag("c").over(w)) - 1, 6).alias("ret"))


def monte_carlo(spark: SparkSession, returns: list[float], iterations: int = 10_000, seed: int = 7) -> DataFrame:
    """Bootstrap of period returns (at most one a day): total return and drawdown percentiles of resampled paths."""
    r = np.asarray(returns, float)

    def run(it):
        for b in it:
            out = []
            for i in b["id"]:
                path = np.cumprod(1 + np.random.default_rng((seed, int(i))).choice(r, len(r))) if len(r) else np.ones(1)
                out.append((path[-1] - 1, (path / np.maximum.accumulate(np.maximum(path, 1.0)) - 1).min()))
            yield pd.DataFrame(out, columns=["total", "dd"])

    x = spark.range(iterations).mapInPandas(run, "total double, dd double")
    p = lambda c: [F.percentile(c, q).alias(f"{c}_p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)]
    return x.agg(F.count("*").alias("iterations"), *p("total"), *p("dd"))
