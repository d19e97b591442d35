"""Research over many backtests: schedules, comparison, grids, walk-forward, stress periods, consensus and baskets.

Every parameter set's periods come from one scored table; sets are keys of groups, not runs of a loop.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import tie_safe
from ..stored import written
from .accounts import Account, account_of, account_periods, ledger
from .backtest import Costs, annual, folded, periods_of, rated

k = F.col


def calendar(bars: DataFrame) -> DataFrame:
    """(trade_date, at): trading days by number from 1 on; as many rows as days."""
    return bars.select("trade_date").distinct().withColumn("at", F.row_number().over(Window.orderBy("trade_date")))


def schedule(bars: DataFrame, hold: int, rolling: bool = False) -> DataFrame:
    """Signal dates: every day, or every `hold` days; with the days of purchase and sale, null where the future is too short."""
    days = calendar(bars)
    day = lambda n: F.lead("trade_date", n).over(Window.orderBy("trade_date"))
    x = days.withColumns({"buy_date": day(1), "sell_date": day(1 + hold)})
    x = x.withColumn("buy_date", F.when(k("sell_date").isNotNull(), k("buy_date")))
    return (x if rolling else x.where((k("at") - 1) % max(1, hold) == 0)).select(k("trade_date").alias("signal_date"), "buy_date", "sell_date")


def next_tradable(wanted: DataFrame, bars: DataFrame, day: str, direction: Column) -> DataFrame:
    """wanted (market, symbol, `day`) with exit_date and exit_price: the first bar from that day on at which the side can trade.

    A long position is not sold at the lower limit, a short one not covered at the upper one, none while suspended.
    """
    blocked = (k("is_suspended") == 1) | F.when(k("side") == "SHORT", k("is_limit_up") == 1).otherwise(k("is_limit_down") == 1)
    w = wanted.withColumn("side", direction)
    sides = bars.select("market", "symbol", "trade_date", "o", "is_suspended", "is_limit_up", "is_limit_down").withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    # As-of forwards: days that are asked for and bars in one order, the next tradable bar being the first from behind.
    asked = w.select("market", "symbol", "side", k(day).alias("trade_date")).distinct()
    both = sides.select("market", "symbol", "side", "trade_date", F.when(~blocked, F.struct("trade_date", "o")).alias("bar")).unionByName(asked.withColumn("bar", F.lit(None).cast("struct<trade_date:date,o:double>")))
    ahead = Window.partitionBy("market", "symbol", "side").orderBy("trade_date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("next", F.first("bar", ignorenulls=True).over(ahead)).groupBy("market", "symbol", "side", k("trade_date").alias(day)).agg(F.min("next").alias("next"))
    return w.join(found, ["market", "symbol", "side", day], "left").select(*wanted.columns, k("next.trade_date").alias("exit_date"), k("next.o").alias("exit_price"))


def compare_backtests(periods: DataFrame) -> DataFrame:
    """By strategy, best annual return first: rated periods (strategy, signal_date, r, n, won) with the mean period and turnover."""
    extra = periods.groupBy("strategy").agg(tie_safe(F.avg("r"), 6).alias("avg_period"), tie_safe(F.sum("n") / F.count("*"), 6).alias("turnover"))
    x = rated(periods, ["strategy"]).drop("research_score").join(extra, "strategy")
    return x.withColumn("place", F.row_number().over(Window.orderBy(k("annual_return").desc(), "strategy")).cast("long"))


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """(combination, axis values as text in a map): the product of every axis."""
    names = sorted(axes)
    rows = [(i, {n: str(v) for n, v in zip(names, values, strict=True)}) for i, values in enumerate(product(*(axes[n] for n in names)))]
    return spark.createDataFrame(rows, "combination long, parameters map<string,string>")


def with_overrides(config: dict, parameters: dict[str, object]) -> dict:
    """A copy of a nested configuration with dotted keys set; missing levels are made."""
    out = {n: with_overrides(v, {}) if isinstance(v, dict) else v for n, v in config.items()}
    for name, value in parameters.items():
        head, _, rest = name.partition(".")
        out[head] = with_overrides(out[head] if isinstance(out.get(head), dict) else {}, {rest: value}) if rest else value
    return out


def configurations(config: dict, axes: dict[str, list]) -> list[dict]:
    """config with every combination of the axes' values set, in the order of :func:`grid`; an empty axis is an error."""
    if empty := [n for n, v in axes.items() if not v]:
        raise ValueError(f"no values: {empty}")
    names = sorted(axes)
    return [with_overrides(config, dict(zip(names, values, strict=True))) for values in product(*(axes[n] for n in names))]


def run_configurations(signals: DataFrame, bars: DataFrame, configs: list[dict]) -> DataFrame:
    """(combination, trades, periods, empty, total_return, annual_return, max_drawdown, win_rate, research_score, place): an
    account for each whole configuration, the best first.

    signals are the widest ones (signal_date, market, symbol, rank, score, amount_ma20). Configurations are rows that meet
    them in a join: each takes its first backtest.top of those that reach strategy.min_score and strategy.min_amount_ma20;
    its exit rules make its account. All accounts are walked in one job, a group each.
    """
    spark = signals.sparkSession
    of = lambda c, table, name, default: (c.get(table) or {}).get(name) or default
    accounts = {f"{i:06d}": account_of(c, int(of(c, "backtest", "hold_days", 5))) for i, c in enumerate(configs)}
    rules = spark.createDataFrame([(n, i, float(of(c, "strategy", "min_score", 0.0)), float(of(c, "strategy", "min_amount_ma20", 0.0)), int(of(c, "backtest", "top", 5))) for i, (n, c) in enumerate(zip(accounts, configs, strict=True))], "account string, combination long, min_score double, min_amount double, top int")
    admitted = signals.join(F.broadcast(rules), (k("score") >= k("min_score")) & (k("amount_ma20") >= k("min_amount")))
    first = Window.partitionBy("account", "signal_date").orderBy("rank", "market", "symbol")
    own = admitted.withColumn("place", F.row_number().over(first)).where(k("place") <= k("top"))
    events = written(ledger(own, bars, accounts), "ledger")
    cash = Account().cash
    days = account_periods(events, bars, accounts=rules)
    peak = F.greatest(F.lit(cash), F.max("equity").over(Window.partitionBy("account").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))
    curve = days.withColumn("drawdown", k("equity") / peak - 1).groupBy("account").agg(F.count("*").alias("periods"), F.count_if("empty").alias("empty"), F.max_by("equity", "trade_date").alias("last"), tie_safe(F.least(F.min("drawdown"), F.lit(0.0)), 6).alias("max_drawdown"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"))
    closed = events.where("kind = 'trade' and sell_date is not null").groupBy("account").agg(F.count("*").alias("trades"), F.count_if(k("net") > 0).alias("won"))
    x = rules.select("account", "combination").join(curve, "account").join(closed, "account", "left")
    x = x.withColumns({"trades": F.coalesce("trades", F.lit(0)), "total_return": tie_safe(k("last") / cash - 1, 6), "win_rate": tie_safe(F.coalesce(F.try_divide("won", "trades"), F.lit(0.0)), 6)})
    x = x.withColumn("annual_return", tie_safe(annual(k("total_return"), k("days")), 6)).withColumn("research_score", tie_safe(k("annual_return") - F.abs("max_drawdown") + 0.1 * k("win_rate"), 6))
    place = F.row_number().over(Window.orderBy(k("research_score").desc(), "combination")).cast("long")  # as many rows as configurations
    return x.select("combination", "trades", "periods", "empty", "total_return", "annual_return", "max_drawdown", "win_rate", "research_score", place.alias("place"))


def diagnostics(scan: DataFrame, key: list[str]) -> DataFrame:
    """One row of a rated scan: sets, best and median score, whether the best is a lone peak, and how many lie on its plateau."""
    order = Window.orderBy(k("research_score").desc(), *key)
    x = scan.select(*key, "research_score").withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy())})
    ends = x.agg(F.max("n").alias("n"), F.max("research_score").alias("best"), F.max(F.when(k("i") == k("n") - F.floor(k("n") / 2), k("research_score"))).alias("median"))
    lone = F.when(k("median") > 0, k("best") > 1.5 * k("median")).otherwise((k("best") > 0) & (k("n") > 1))
    near = F.abs(k("research_score") - k("best")) <= F.greatest(F.abs("best") * 0.1, F.lit(0.02))
    return x.drop("n").crossJoin(F.broadcast(ends)).where(near).groupBy("n", "best", "median").agg(F.count("*").alias("plateau")).select("n", "best", "median", lone.alias("isolated_peak"), "plateau")


def fold_trades(t: DataFrame, starts: DataFrame, first: int, n: int) -> DataFrame:
    """Trades of every phase that are signalled and closed within its years [start + first, start + first + n).

    A trade that closes after the fold's last day is cut: its result was not known there, and it would carry what happened
    in the test years into the training.
    """
    year, closed = F.year("signal_date"), F.year("sell_date")
    return t.join(F.broadcast(starts), (year >= k("start") + first) & (closed < k("start") + first + n) & (year < k("start") + first + n))


def stitched(p: DataFrame, phase: str = "start") -> DataFrame:
    """Periods (phase, ..., signal_date, r) with equity: each phase compounds from 1, rounded to six places at every step, and
    is scaled so that its first value is the last one of the phase before.

    A phase is one path of as many periods as its days, and there are as few phases as years.
    """
    step = lambda acc, x: F.struct(tie_safe(acc["e"] * (1 + x["r"]), 6).alias("e"), F.concat(acc["path"], F.array(tie_safe(acc["e"] * (1 + x["r"]), 6))).alias("path"))
    rows = F.array_sort(F.collect_list(F.struct(*[k(c) for c in ("signal_date", *[c for c in p.columns if c not in (phase, "signal_date")])])))
    start = F.struct(F.lit(1.0).alias("e"), F.array().cast("array<double>").alias("path"))
    paths = p.groupBy(phase).agg(rows.alias("rows")).withColumn("path", F.aggregate("rows", start, step, lambda acc: acc["path"]))
    ends = paths.select(phase, F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("z"))
    chain = lambda acc, x: F.struct(tie_safe(x["z"] * (acc["now"] / x["a"]), 6).alias("now"), F.concat(acc["scales"], F.array(F.struct(x[phase].alias(phase), (acc["now"] / x["a"]).alias("scale")))).alias("scales"))
    kind = p.schema[phase].dataType.simpleString()
    begin = F.struct(F.lit(1.0).alias("now"), F.array().cast(f"array<struct<{phase}:{kind},scale:double>>").alias("scales"))
    scales = ends.agg(F.array_sort(F.collect_list(F.struct(phase, "a", "z"))).alias("ends")).select(F.explode(F.aggregate("ends", begin, chain, lambda acc: acc["scales"])).alias("s")).select("s.*")
    out = paths.join(F.broadcast(scales), phase).select(phase, "scale", F.explode(F.arrays_zip("rows", "path")).alias("x"))
    return out.select(phase, "x.rows.*", tie_safe(k("x.path") * k("scale"), 6).alias("equity"))


def walk_forward(trades: DataFrame, key: list[str], train_years: int = 3, test_years: int = 1) -> DataFrame:
    """(phase, key..., train_score, signal_date, r, n, equity): in each phase the set that rated best over the training years trades the test years.

    trades (key..., signal_date, sell_date, net) hold every set's whole past, so each phase is a filter of one table. Phases
    move by the test years; a trade counts in a fold if it was signalled and closed in it.
    """
    years = F.year("signal_date")
    span = trades.agg(F.min(years).alias("lo"), F.max(years).alias("hi"))
    starts = span.select(F.explode_outer(F.when(k("lo") + train_years <= k("hi"), F.sequence(k("lo"), k("hi") - train_years, F.lit(test_years)))).alias("start")).where("start is not null")
    scores = rated(periods_of(fold_trades(trades, starts, 0, train_years), ["start", *key]), ["start", *key])
    best = scores.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(k("research_score").desc(), *key))).where("place = 1")
    test = periods_of(fold_trades(trades, starts, train_years, test_years), ["start", *key])
    rows = test.join(F.broadcast(best.select("start", *key, k("research_score").alias("train_score"))), ["start", *key])
    return stitched(rows.select("start", *key, "train_score", "signal_date", "r", "n")).withColumnRenamed("start", "phase").select("phase", *key, "train_score", "signal_date", "r", "n", "equity")


def stress(periods: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """By named span of days: rated periods of the signals within it; spans may overlap."""
    spans = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in named.items()])
    x = periods.withColumn("s", F.explode(spans)).where((k("signal_date") >= k("s.a")) & (k("signal_date") <= k("s.b")))
    return rated(x.select(k("s.period").alias("period"), "signal_date", "r", "n", "won"), ["period"])


def consensus_periods(picks: DataFrame, bars: DataFrame, hold: int, top: int, costs: Costs = Costs()) -> DataFrame:
    """(signal_date, r, n, won) of every day: the first consensus picks, bought and sold at the opens of exact days; 0 without trades.

    Days without enough future are periods without trades.
    """
    days = schedule(bars, hold, rolling=True)
    chosen = picks.where(k("rank") <= top).select(k("trade_date").alias("signal_date"), "market", "symbol").join(days.where("buy_date is not null"), "signal_date")
    price = lambda day, name: bars.select("market", "symbol", k("trade_date").alias(day), k("o").alias(name))
    t = chosen.join(price("buy_date", "b"), ["market", "symbol", "buy_date"]).join(price("sell_date", "s"), ["market", "symbol", "sell_date"])
    done = t.withColumn("net", F.try_divide("s", "b") - 1 - costs.round_trip).groupBy("signal_date").agg(tie_safe(F.avg("net"), 6).alias("r"), F.count("net").alias("n"), F.count_if(k("net") > 0).alias("won"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return days.select("signal_date").join(done, "signal_date", "left").select("signal_date", zero("r", 0.0), zero("n", 0), zero("won", 0))


def basket_periods(weighted: DataFrame, bars: DataFrame, every: int = 5, costs_bps: float = 13.0) -> DataFrame:
    """(signal_date, holdings, missing, period_return, turnover, equity): portfolios rebalanced every so many days, open to open.

    A holding without a price adds nothing; turnover is half the absolute change of weights from the basket before.
    """
    days = calendar(bars)
    last = days.agg(F.max("at").alias("n"))
    at = lambda n: F.broadcast(days.select(k("at").alias(n), k("trade_date").alias(n + "_date")))
    due = days.crossJoin(F.broadcast(last)).where(((k("at") - 1) % max(1, every) == 0) & (k("at") < k("n"))).select(k("trade_date").alias("signal_date"), (k("at") + 1).alias("buy"), F.least(k("at") + 1 + max(1, every), k("n")).alias("sell"), F.floor((k("at") - 1) / max(1, every)).alias("turn"))
    due = due.join(at("buy"), "buy").join(at("sell"), "sell")
    held = weighted.where("weight > 0").select(k("trade_date").alias("signal_date"), "market", "symbol", "weight").join(due, "signal_date")
    price = lambda day, name: bars.select("market", "symbol", k("trade_date").alias(day), k("o").alias(name))
    t = held.join(price("buy_date", "b"), ["market", "symbol", "buy_date"], "left").join(price("sell_date", "s"), ["market", "symbol", "sell_date"], "left")
    good = (k("b") > 0) & k("s").isNotNull()
    net = F.when(good, k("weight") * (k("s") / k("b") - 1 - 2 * costs_bps / 10_000))
    done = t.groupBy("signal_date").agg(F.count("*").alias("holdings"), F.count_if(~F.coalesce(good, F.lit(False))).alias("missing"), F.coalesce(F.sum(net), F.lit(0.0)).alias("r"))
    now = held.select("turn", "market", "symbol", "weight")
    before = now.select((k("turn") + 1).alias("turn"), "market", "symbol", k("weight").alias("was"))
    change = now.join(before, ["turn", "market", "symbol"], "full_outer").groupBy("turn").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("t"))
    x = due.select("signal_date", "turn").join(done, "signal_date", "left").join(change, "turn", "left")
    w = Window.orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce("r", F.lit(0.0))
    return x.select("signal_date", F.coalesce("holdings", F.lit(0)).alias("holdings"), F.coalesce("missing", F.lit(0)).alias("missing"), tie_safe(r, 6).alias("period_return"), tie_safe(F.coalesce("t", F.lit(0.0)), 6).alias("turnover"), tie_safe(F.exp(F.sum(F.log1p(r)).over(w)), 6).alias("equity"))


def against_benchmark(curve: DataFrame, bars: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """curve (signal_date, equity) with the return so far of the first benchmark of `order` that has two bars or more, by date."""
    place = F.create_map(*[x for i, (m, s) in enumerate(order) for x in (F.lit(f"{m}{s}"), F.lit(i))])
    own = bars.select(k("trade_date").alias("signal_date"), place[F.concat("market", "symbol")].alias("place"), "c").where("place is not null")
    usable = own.groupBy("place").agg(F.count("*").alias("n"), F.min_by("c", "signal_date").alias("base")).where("n >= 2").orderBy("place").limit(1)
    bench = own.join(F.broadcast(usable.select("place", "base")), "place").select("signal_date", tie_safe(F.try_divide("c", "base") - 1, 6).alias("benchmark_return"))
    return curve.join(bench, "signal_date", "left")


def yearly(periods: DataFrame, key: list[str]) -> DataFrame:
    """By key and year: compounded return of the periods, six places."""
    x = folded(periods.withColumn("year", F.year("signal_date")), [*key, "year"])
    return x.select(*key, "year", "periods", tie_safe(k("last") - 1, 6).alias("total_return"), tie_safe(annual(k("last") - 1, k("days")), 6).alias("annual_return"), "max_drawdown")
