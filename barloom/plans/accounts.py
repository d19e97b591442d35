"""Accounts with shared cash, day by day: exits before entries, all at the open of a market day.

A signal is bought on the next day of the market's calendar, at its own instrument's open of that day, or not at all. What
happens to a position once it is bought does not depend on cash, so joins and windows find every exit; what is left is one
path through time for each account, of a few rows a day, which is walked in one group of rows an account.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tie_safe

k = F.col


@dataclass(frozen=True)
class Account:
    cash: float = 1_000_000.0
    max_positions: int = 5
    hold_days: int = 5
    max_hold_days: int | None = None
    min_hold_days: int = 1
    hard_stop: float | None = 0.12
    chandelier: float | None = None
    stop_atr: float | None = None
    trailing: float | None = None
    profit_atr: float | None = None
    stop_loss: float | None = 0.08
    take_profit: float | None = None
    ma_break: bool = False
    momentum: bool = False
    score_below: float | None = None
    #: A mean range as a share of the purchase price.
    atr_share: float = 0.02
    #: From this yearly volatility on, and down to that one, the stop's multiple is another.
    high_volatility: tuple[float, float] | None = None
    low_volatility: tuple[float, float] | None = None
    margin_rate: float = 0.5
    fee: float = 0.0003
    slip: float = 0.001
    lot: int = 100

    @property
    def stop_multiple(self) -> float | None:
        year = self.atr_share * 252**0.5
        if self.stop_atr is None:
            return None
        if self.high_volatility and year >= self.high_volatility[0]:
            return self.high_volatility[1]
        if self.low_volatility and year <= self.low_volatility[0]:
            return self.low_volatility[1]
        return self.stop_atr


def shares(cash: float, price: float, initial: float, positions: int, lot: int = 100) -> int:
    """What an equal part of the initial cash, or what is left, buys in whole lots."""
    return int(min(initial / positions, cash) / price // lot) * lot if price > 0 and cash > 0 and positions > 0 else 0


def exit_rules(a: Account) -> Column:
    """The reason for leaving at a bar's open, null for staying; columns: o, h, l, c, top (highest high), buy_price, days, direction, last_score."""
    atr = F.greatest(k("buy_price") * max(a.atr_share, 0.001), F.lit(0.01))
    rules: list[tuple[str, Column]] = []
    if a.chandelier:
        rules.append(("chandelier_stop", k("o") <= k("top") - a.chandelier * atr))
    if a.stop_multiple:
        rules.append(("atr_stop_loss", k("o") <= k("top") - a.stop_multiple * atr))
    if a.trailing:
        rules.append(("trailing_take_profit", k("o") <= k("top") * (1 - a.trailing)))
    if a.profit_atr:
        rules.append(("atr_take_profit", k("o") >= k("buy_price") + a.profit_atr * atr))
    if a.stop_loss:
        rules.append(("stop_loss", k("o") <= k("buy_price") * (1 - a.stop_loss)))
    if a.take_profit:
        rules.append(("take_profit", k("o") >= k("buy_price") * (1 + a.take_profit)))
    if a.ma_break:
        rules.append(("ma_breakdown", k("c") < (k("c") + k("h") + k("l") + k("o")) / 4))
    if a.momentum:
        rules.append(("momentum_negative", k("c") < k("o")))
    long = k("direction") != "SHORT"
    out = F.lit(None).cast("string")
    technical = F.lit(None).cast("string")
    for name, when in reversed(rules):
        technical = F.when(when, name).otherwise(technical)
    if a.hard_stop:
        out = F.when(long & (k("o") <= k("buy_price") * (1 - a.hard_stop)), "hard_stop_loss")
    out = F.coalesce(out, F.when(long & (k("days") >= max(a.min_hold_days, 0)), technical))
    if a.score_below is not None:
        out = F.coalesce(out, F.when(k("last_score") < a.score_below, "score_below_threshold"))
    if a.max_hold_days is not None:
        out = F.coalesce(out, F.when(k("days") >= a.max_hold_days, "max_holding_days"))
    return F.coalesce(out, F.when(k("days") >= a.hold_days, "hold_days"))


def account_of(config: Mapping, hold_days: int = 5, base: Account = Account()) -> Account:
    """The account that the tables backtest, exit_rules and stop_loss of a configuration describe."""
    table = lambda of, *names: table(of.get(names[0]) if isinstance(of.get(names[0]), Mapping) else {}, *names[1:]) if names else of
    number = lambda x: None if x in (None, "") else float(x)
    rules, stop = table(config, "exit_rules"), table(config, "stop_loss")
    technical, longest = table(rules, "technical"), table(rules, "max_hold")
    adaptive, chandelier, trailing = (table(stop, n) for n in ("volatility_adaptive", "chandelier", "trailing"))
    method = str(stop.get("method") or "").lower()
    multiple = number(technical.get("stop_loss_atr"))
    if multiple is None and method in ("fixed_atr", "volatility_adaptive"):
        multiple = number(adaptive.get("base_multiplier"))
    if multiple is None and method == "chandelier":
        multiple = number(chandelier.get("multiplier"))
    pair = lambda side: (float(adaptive[f"{side}_volatility_threshold"]), float(adaptive[f"{side}_volatility_multiplier"])) if {f"{side}_volatility_threshold", f"{side}_volatility_multiplier"} <= adaptive.keys() else None
    return replace(
        base,
        max_positions=int(table(config, "backtest").get("top") or 5),
        hold_days=hold_days,
        max_hold_days=int(longest.get("max_days") or hold_days),
        min_hold_days=int(longest.get("min_days") or 1),
        stop_loss=None if rules.get("enabled", bool(rules)) else 0.08,
        stop_atr=multiple,
        profit_atr=number(technical.get("take_profit_atr")),
        chandelier=number(chandelier.get("multiplier")),
        trailing=number(trailing.get("pullback_pct")) if trailing.get("enabled") else None,
        ma_break=bool(technical.get("stop_loss_ma20", False)),
        momentum=bool(technical.get("momentum_turn_negative", False)),
        score_below=number(table(rules, "signal_exit").get("exit_when_score_below")),
        high_volatility=pair("high"),
        low_volatility=pair("low"),
    )


def market_days(bars: DataFrame) -> DataFrame:
    """(trade_date, next_date, at): the market's calendar; as many rows as days."""
    w = Window.orderBy("trade_date")
    return bars.select("trade_date").distinct().select("trade_date", F.lead("trade_date").over(w).alias("next_date"), F.row_number().over(w).alias("at"))


def with_accounts(signals: DataFrame) -> DataFrame:
    """signals with account, direction and due_date; the market day after the signal's is added by :func:`outcomes`."""
    have = set(signals.columns)
    account = k("account").cast("string") if "account" in have else F.lit("main")
    direction = F.when(F.upper("direction") == "SHORT", "SHORT").otherwise("LONG") if "direction" in have else F.lit("LONG")
    return signals.select(F.coalesce(account, F.lit("main")).alias("account"), "signal_date", F.lower("market").alias("market"), "symbol", "rank", "score", direction.alias("direction"))


def bars_of(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """The whole series of the instruments that signals (market, symbol) name: a semi join by what windows are partitioned by,
    so that Spark drops the other instruments before the windows that it can push the join below."""
    return bars.join(signals.select("market", "symbol"), ["market", "symbol"], "left_semi")


def outcomes(signals: DataFrame, bars: DataFrame, a: Account) -> DataFrame:
    """What each signal (account, signal_date, market, symbol, rank, score, direction) would do if it were bought: (..., buy_date,
    buy_price, blocked, sell_date, sell_price, exit_reason).

    It is bought on the market day after its own; without a bar of its instrument on that day it is blocked, as where the
    side cannot be opened. A position meets the bars up to the first one on which it may be closed after its holding time;
    blocked bars are passed over. A later signal of the same account and instrument brings its score on the market day
    after its own. Signals are independent, so all of this is equi-joins by instrument and windows by signal.
    """
    s = with_accounts(signals).join(F.broadcast(market_days(bars).select(k("trade_date").alias("signal_date"), k("next_date").alias("buy_date"))), "signal_date").where("buy_date is not null")
    stuck = lambda side: (k("is_suspended") == 1) | (k(f"is_limit_{side}") == 1)
    by = Window.partitionBy("market", "symbol")
    later = by.orderBy(F.unix_date("trade_date")).rangeBetween(a.hold_days if a.max_hold_days is None else min(a.hold_days, a.max_hold_days), Window.unboundedFollowing)
    b = bars_of(s, bars).select("market", "symbol", "trade_date", "rn", "o", "h", "l", "c", "is_limit_up", "is_limit_down", "is_suspended")
    ends = b.withColumns({f"end_{n}": F.coalesce(F.min(F.when(~stuck(side), k("rn"))).over(later), F.max("rn").over(by)) for n, side in (("long", "down"), ("short", "up"))})
    short = k("direction") == "SHORT"
    first = ends.select("market", "symbol", k("trade_date").alias("buy_date"), k("rn").alias("buy_rn"), k("o").alias("buy_price"), k("h").alias("buy_high"), "end_long", "end_short", stuck("up").alias("no_long"), stuck("down").alias("no_short"))
    key = ["account", "market", "symbol", "signal_date", "direction"]
    buy = s.join(first, ["market", "symbol", "buy_date"], "left")
    buy = buy.withColumns({"blocked": k("buy_rn").isNull() | F.when(short, k("no_short")).otherwise(k("no_long")), "end": F.when(short, k("end_short")).otherwise(k("end_long"))})
    held = buy.where(~k("blocked") & (k("end") > k("buy_rn"))).select(*key, "buy_date", "buy_price", "buy_high", "buy_rn", "end", "score").dropDuplicates(key)
    days = held.withColumn("rn", F.explode(F.sequence(k("buy_rn") + 1, k("end"))))
    walk = days.join(b, ["market", "symbol", "rn"]).withColumn("days", F.datediff("trade_date", "buy_date"))
    own = Window.partitionBy(*key).orderBy("trade_date", "bar").rowsBetween(Window.unboundedPreceding, 0)
    if a.score_below is None:
        walk = walk.withColumns({"bar": F.lit(1), "last_score": k("score")})
    else:
        news = s.groupBy("account", "market", "symbol", k("buy_date").alias("trade_date")).agg(F.max_by("score", F.struct("rank", "score")).alias("news"))
        span = held.join(b.select("market", "symbol", k("rn").alias("end"), k("trade_date").alias("until")), ["market", "symbol", "end"])
        brought = span.join(news, ["account", "market", "symbol"]).where((k("trade_date") > k("buy_date")) & (k("trade_date") <= k("until"))).select(*key, "trade_date", "news")
        walk = walk.withColumn("bar", F.lit(1)).unionByName(brought.withColumn("bar", F.lit(0)), allowMissingColumns=True)
        walk = walk.withColumn("last_score", F.coalesce(F.last("news", ignorenulls=True).over(own), k("score"))).where("bar = 1")
    open_ = walk.where(~F.when(short, stuck("up")).otherwise(stuck("down")))
    # The highest high counts bars at which the technical rules are asked.
    top = F.max(F.when(k("days") >= a.min_hold_days, k("h"))).over(own)
    left = open_.withColumn("top", F.greatest("buy_high", top)).withColumn("exit_reason", exit_rules(a)).where("exit_reason is not null")
    exits = left.groupBy(*key).agg(F.min_by(F.struct("trade_date", "o", "exit_reason"), "trade_date").alias("x"))
    return buy.join(exits, key, "left").select(*key, "rank", "score", "buy_date", "buy_price", "blocked", k("x.trade_date").alias("sell_date"), k("x.o").alias("sell_price"), k("x.exit_reason").alias("exit_reason"))


LEDGER = "account string, kind string, day date, reason string, market string, symbol string, direction string, signal_date date, buy_date date, sell_date date, shares long, buy_price double, sell_price double, gross double, net double"


def ledger(signals: DataFrame, bars: DataFrame, a: Account | Mapping[str, Account] = Account()) -> DataFrame:
    """Everything that accounts do: rows of kind "trade" (open ones without sell_date) and "skip" (a day's signal passed over, with the reason).

    signals: signal_date, market, symbol, rank, score[, account, direction]; accounts trade apart, each by its own
    signals. a may name the parameters of every account; accounts with equal parameters are worked out together.
    """
    each = a if isinstance(a, Mapping) else {}
    known = None
    for one in dict.fromkeys(each.values() if each else [a]):
        own = signals
        if each:
            named = [n for n, x in each.items() if x == one]
            own = signals.where(F.coalesce(k("account").cast("string"), F.lit("main")).isin(named))
        part = outcomes(own, bars, one)
        known = part if known is None else known.unionByName(part)
    columns = [f.split(" ")[0] for f in LEDGER.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name = g["account"].iloc[0]
        p = each[name] if each else a
        cost = p.fee + p.slip
        cash, margin, held, out, full = p.cash, 0.0, {}, [], None
        rows = list(g.itertuples(index=False))
        # A day's exits come before its entries, and these in the order of their ranks.
        events = [(r.sell_date, 0, 0, "", "", i) for i, r in enumerate(rows) if not pd.isna(r.sell_date)]
        events += [(r.buy_date, 1, r.rank, r.market, r.symbol, i) for i, r in enumerate(rows)]

        def skip(r, reason: str) -> None:
            out.append((name, "skip", r.buy_date, reason, r.market, r.symbol, r.direction, r.signal_date, None, None, None, None, None, None, None))

        for day, kind, *_, i in sorted(events):
            r = rows[i]
            short = r.direction == "SHORT"
            if kind == 0:
                if held.get(r.symbol, (None,))[0] != i:
                    continue
                _, n, locked = held.pop(r.symbol)
                if short:
                    cash -= n * r.sell_price * (1 + cost)
                    margin = max(0.0, margin - locked)
                    gross = r.buy_price / r.sell_price - 1
                    net = gross - 2 * cost
                else:
                    cash += n * r.sell_price * (1 - cost)
                    gross = r.sell_price / r.buy_price - 1
                    net = r.sell_price * (1 - cost) / (r.buy_price * (1 + cost)) - 1
                out.append((name, "trade", r.sell_date, r.exit_reason, r.market, r.symbol, r.direction, r.signal_date, r.buy_date, r.sell_date, n, r.buy_price, r.sell_price, round(gross, 6), round(net, 6)))
                continue
            if full == day:
                continue
            if len(held) >= p.max_positions:
                full = day  # nothing more is looked at on this day
                skip(r, "max_positions")
                continue
            if r.symbol in held:
                continue
            if r.blocked:
                skip(r, "limit_down/suspended" if short else "limit_up/suspended")
                continue
            free = max(0.0, cash - margin)
            n = shares(free, r.buy_price, p.cash, p.max_positions, p.lot)
            locked = n * r.buy_price * p.margin_rate if short else 0.0
            if n < p.lot or not short and n * r.buy_price * (1 + cost) > free:
                skip(r, "insufficient_cash")
                continue
            if locked > free:
                skip(r, "insufficient_margin")
                continue
            cash += n * r.buy_price * (1 - cost) if short else -n * r.buy_price * (1 + cost)
            margin += locked
            held[r.symbol] = (i, n, locked)
        for i, n, _ in held.values():
            r = rows[i]
            out.append((name, "trade", None, None, r.market, r.symbol, r.direction, r.signal_date, r.buy_date, None, n, r.buy_price, None, None, None))
        return pd.DataFrame(out, columns=columns).astype({"shares": "Int64"})

    return known.groupBy("account").applyInPandas(run, LEDGER)


def simulate(signals: DataFrame, bars: DataFrame, a: Account | Mapping[str, Account] = Account()) -> DataFrame:
    """The trades of :func:`ledger`; open positions have no sell_date."""
    return ledger(signals, bars, a).where("kind = 'trade'").select("account", "market", "symbol", "direction", "signal_date", "buy_date", "sell_date", "shares", "buy_price", "sell_price", "gross", "net", k("reason").alias("exit_reason"))


def marked_equity(done: DataFrame, bars: DataFrame, a: Account = Account(), accounts: DataFrame | None = None) -> DataFrame:
    """(account, trade_date, cash, market_value, equity) of every day, positions at the day's close (without a bar: at their price).

    A position is spread over the numbers of the market days on which it is open, and meets bars by equal keys.
    """
    cost = a.fee + a.slip
    side = F.when(k("direction") == "SHORT", -1.0).otherwise(1.0)
    bought = done.select("account", k("buy_date").alias("trade_date"), (-side * k("shares") * k("buy_price") * (1 + side * cost)).alias("flow"))
    sold = done.where("sell_date is not null").select("account", k("sell_date").alias("trade_date"), (side * k("shares") * k("sell_price") * (1 - side * cost)).alias("flow"))
    flows = bought.union(sold).groupBy("account", "trade_date").agg(F.sum("flow").alias("flow"))
    dates = market_days(bars).select("trade_date", "at")
    named = (done if accounts is None else accounts).select("account").distinct()
    cash = dates.crossJoin(F.broadcast(named)).join(flows, ["account", "trade_date"], "left").withColumn("cash", a.cash + F.sum(F.coalesce("flow", F.lit(0.0))).over(Window.partitionBy("account").orderBy("trade_date")))
    number = lambda day, name: F.broadcast(dates.select(k("trade_date").alias(day), k("at").alias(name)))
    last = dates.agg(F.max("at").alias("final"))
    open_ = done.join(number("buy_date", "first"), "buy_date").join(number("sell_date", "gone"), "sell_date", "left").crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(k("gone") - 1, k("final")))
    open_ = open_.where("until >= first").withColumn("at", F.explode(F.sequence("first", "until"))).join(F.broadcast(dates), "at")
    value = open_.join(bars.select("market", "symbol", "trade_date", "c"), ["market", "symbol", "trade_date"], "left").groupBy("account", "trade_date").agg(F.sum(side * k("shares") * F.coalesce("c", "buy_price")).alias("market_value"))
    x = cash.join(value, ["account", "trade_date"], "left").withColumn("market_value", F.coalesce("market_value", F.lit(0.0)))
    return x.select("account", "trade_date", tie_safe("cash", 6).alias("cash"), tie_safe("market_value", 6).alias("market_value"), tie_safe(k("cash") + k("market_value"), 6).alias("equity"))


def account_periods(events: DataFrame, bars: DataFrame, a: Account = Account(), accounts: DataFrame | None = None) -> DataFrame:
    """(account, trade_date, bought, sold, open, empty, period_return, equity, skipped) of every market day of :func:`ledger`'s events.

    skipped is the day's reasons in the order of their names, with repeats. accounts (account) may name some without events.
    """
    trades = events.where("kind = 'trade'")
    curve = marked_equity(trades, bars, a, events if accounts is None else accounts)
    count = lambda df, day, name: df.groupBy("account", k(day).alias("trade_date")).agg(F.count("*").alias(name))
    bought, sold = count(trades, "buy_date", "bought"), count(trades.where("sell_date is not null"), "sell_date", "sold")
    skipped = events.where("kind = 'skip'").groupBy("account", k("day").alias("trade_date")).agg(F.array_sort(F.collect_list("reason")).alias("skipped"))
    x = curve.join(bought, ["account", "trade_date"], "left").join(sold, ["account", "trade_date"], "left").join(skipped, ["account", "trade_date"], "left")
    w = Window.partitionBy("account").orderBy("trade_date")
    zero = lambda c: F.coalesce(k(c), F.lit(0))
    x = x.withColumns({"bought": zero("bought"), "sold": zero("sold")}).withColumn("open", F.sum(k("bought") - k("sold")).over(w))
    before = F.coalesce(F.lag("equity").over(w), F.lit(a.cash))
    return x.select("account", "trade_date", "bought", "sold", "open", ((k("bought") == 0) & (k("sold") == 0) & (k("open") == 0)).alias("empty"), tie_safe(F.when(before > 0, k("equity") / before - 1).otherwise(0.0), 6).alias("period_return"), "equity", F.coalesce("skipped", F.array().cast("array<string>")).alias("skipped"))
