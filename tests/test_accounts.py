"""Accounts against a plain walk over days, written from the rules alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from barloom.plans import backtest as bt
from barloom.plans import research as rs
from barloom.plans.accounts import account_of

BARS = "market string, symbol string, trade_date date, rn long, o double, h double, l double, c double, is_limit_up int, is_limit_down int, is_suspended int"
SIGNALS = "account string, signal_date date, market string, symbol string, rank int, score double, direction string"


def leave(pos, bar, a, days):
    """Why a position is left at this bar, or None; remembers the highest high."""
    atr = max(pos["price"] * max(a.atr_share, 0.001), 0.01)
    o, h, low, c = bar["o"], bar["h"], bar["l"], bar["c"]
    if pos["side"] == "LONG":
        if a.hard_stop and o <= pos["price"] * (1 - a.hard_stop):
            return "hard_stop_loss"
        if days >= max(a.min_hold_days, 0):
            pos["top"] = max(pos["top"], h)
            if a.chandelier and o <= pos["top"] - a.chandelier * atr:
                return "chandelier_stop"
            if a.stop_multiple and o <= pos["top"] - a.stop_multiple * atr:
                return "atr_stop_loss"
            if a.trailing and o <= pos["top"] * (1 - a.trailing):
                return "trailing_take_profit"
            if a.profit_atr and o >= pos["price"] + a.profit_atr * atr:
                return "atr_take_profit"
            if a.stop_loss and o <= pos["price"] * (1 - a.stop_loss):
                return "stop_loss"
            if a.take_profit and o >= pos["price"] * (1 + a.take_profit):
                return "take_profit"
            if a.ma_break and c < (c + h + low + o) / 4:
                return "ma_breakdown"
            if a.momentum and c < o:
                return "momentum_negative"
    if a.score_below is not None and pos["score"] < a.score_below:
        return "score_below_threshold"
    if a.max_hold_days is not None and days >= a.max_hold_days:
        return "max_holding_days"
    return "hold_days" if days >= a.hold_days else None


def walk(signals, bars, a):
    """(trades, {day: (equity, skipped reasons, activity)}) of one account."""
    days = sorted({b["trade_date"] for b in bars})
    at = {(b["market"], b["symbol"], b["trade_date"]): b for b in bars}
    cash, margin, held, trades, marks = a.cash, 0.0, {}, [], {}
    cost = a.fee + a.slip
    for i, today in enumerate(days):
        yesterday = days[i - 1] if i else None
        own = sorted((s for s in signals if s["signal_date"] == yesterday), key=lambda s: (s["rank"], s["market"], s["symbol"]))
        news = {(s["market"], s["symbol"]): s["score"] for s in own}
        skipped, moves = [], 0
        for symbol, p in list(held.items()):
            p["score"] = news.get((p["market"], symbol), p["score"])
            bar = at.get((p["market"], symbol, today))
            if bar is None or bar["is_suspended"] or (bar["is_limit_up"] if p["side"] == "SHORT" else bar["is_limit_down"]):
                continue
            why = leave(p, bar, a, (today - p["bought"]).days)
            if why is None:
                continue
            if p["side"] == "SHORT":
                cash -= p["n"] * bar["o"] * (1 + cost)
                margin = max(0.0, margin - p["locked"])
                gross = p["price"] / bar["o"] - 1
                net = gross - 2 * cost
            else:
                cash += p["n"] * bar["o"] * (1 - cost)
                gross = bar["o"] / p["price"] - 1
                net = bar["o"] * (1 - cost) / (p["price"] * (1 + cost)) - 1
            trades.append((p["market"], symbol, p["side"], p["signal"], p["bought"], today, p["n"], round(gross, 6), round(net, 6), why))
            del held[symbol]
            moves += 1
        for s in own:
            if len(held) >= a.max_positions:
                skipped.append("max_positions")
                break
            if s["symbol"] in held:
                continue
            bar, short = at.get((s["market"], s["symbol"], today)), s["direction"] == "SHORT"
            if bar is None or bar["is_suspended"] or (bar["is_limit_down"] if short else bar["is_limit_up"]):
                skipped.append("limit_down/suspended" if short else "limit_up/suspended")
                continue
            free = max(0.0, cash - margin)
            n = int(min(a.cash / a.max_positions, free) / bar["o"] // 100) * 100
            if n < 100 or not short and n * bar["o"] * (1 + cost) > free:
                skipped.append("insufficient_cash")
                continue
            locked = n * bar["o"] * a.margin_rate if short else 0.0
            if locked > free:
                skipped.append("insufficient_margin")
                continue
            cash += n * bar["o"] * (1 - cost) if short else -n * bar["o"] * (1 + cost)
            margin += locked
            held[s["symbol"]] = {"market": s["market"], "side": "SHORT" if short else "LONG", "signal": yesterday, "bought": today, "price": bar["o"], "n": n, "locked": locked, "score": s["score"], "top": bar["h"]}
            moves += 1
        value = sum((-1 if p["side"] == "SHORT" else 1) * p["n"] * at.get((p["market"], x, today), {"c": p["price"]})["c"] for x, p in held.items())
        marks[today] = (cash + value, sorted(skipped), moves, len(held))
    trades += [(p["market"], x, p["side"], p["signal"], p["bought"], None, p["n"], None, None, None) for x, p in held.items()]
    return trades, marks


def made(seed):
    """Bars with gaps and blocked days, and signals of two accounts."""
    r = random.Random(seed)
    days = [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(70) if n % 7 < 5]
    bars = []
    for j in range(6):
        price, rn = 10.0 + 3 * j, 0
        for d in days:
            if r.random() < 0.15:
                continue  # no bar on this day
            rn += 1
            o = round(price * (1 + r.uniform(-0.06, 0.06)), 2)
            price = round(o * (1 + r.uniform(-0.05, 0.05)), 2)
            bars.append({"market": "sh" if j % 2 else "sz", "symbol": f"60000{j}", "trade_date": d, "rn": rn, "o": o, "h": max(o, price) + 0.2, "l": min(o, price) - 0.2, "c": price, "is_limit_up": int(r.random() < 0.08), "is_limit_down": int(r.random() < 0.08), "is_suspended": int(r.random() < 0.05)})
    have = [(b["market"], b["symbol"], b["trade_date"]) for b in bars]
    signals = []
    for account in ("x", "y"):
        for d in days:
            own = [h for h in have if h[2] == d and r.random() < 0.5]
            signals += [{"account": account, "signal_date": d, "market": m, "symbol": s, "rank": i, "score": float(r.randint(40, 90)), "direction": "SHORT" if account == "y" and r.random() < 0.5 else "LONG"} for i, (m, s, _) in enumerate(r.sample(own, len(own)), 1)]
    return bars, signals


CASES = [
    bt.Account(cash=20_000, max_positions=3, margin_rate=0.5),
    bt.Account(cash=100_000, max_positions=2, hold_days=9, min_hold_days=3, chandelier=2.0, take_profit=0.06, score_below=55.0),
    bt.Account(cash=6_000, max_positions=4, hold_days=20, max_hold_days=11, trailing=0.05, stop_atr=2.0, profit_atr=4.0, margin_rate=1.5, ma_break=True),
    bt.Account(cash=50_000, hold_days=15, hard_stop=None, stop_loss=None, momentum=True, min_hold_days=0, score_below=60.0, fee=0.0, slip=0.0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_equals_a_walk_over_days(spark, case):
    a = CASES[case]
    bars, signals = made(case)
    b = spark.createDataFrame([Row(**x) for x in bars], BARS).cache()
    s = spark.createDataFrame([Row(**x) for x in random.Random(1).sample(signals, len(signals))], SIGNALS).repartition(3).cache()
    events = bt.ledger(s, b, a).cache()
    got = {n: set() for n in "xy"}
    for r in events.where("kind = 'trade'").collect():
        got[r.account].add((r.market, r.symbol, r.direction, r.signal_date, r.buy_date, r.sell_date, r.shares, r.gross, r.net, r.reason))
    periods = {(r.account, r.trade_date): r for r in bt.account_periods(events, b, a).collect()}
    for n in "xy":
        trades, marks = walk([x for x in signals if x["account"] == n], bars, a)
        assert got[n] == set(trades) and len(trades) > 5
        for day, (equity, skipped, moves, held) in marks.items():
            p = periods[n, day]
            assert p.equity == pytest.approx(equity, abs=1e-5) and p.skipped == skipped and p.bought + p.sold == moves and p.open == held and p.empty == (moves == 0 and held == 0), (n, day)
    assert any(t[2] == "SHORT" for t in got["y"]) and not any(t[2] == "SHORT" for t in got["x"])


def test_accounts_of_different_parameters(spark):
    bars, signals = made(7)
    b = spark.createDataFrame([Row(**x) for x in bars], BARS)
    s = spark.createDataFrame([Row(**x) for x in signals], SIGNALS)
    both = bt.simulate(s, b, {"x": CASES[0], "y": CASES[1]}).collect()
    for n, a in (("x", CASES[0]), ("y", CASES[1])):
        trades, _ = walk([q for q in signals if q["account"] == n], bars, a)
        assert {(r.market, r.symbol, r.direction, r.signal_date, r.buy_date, r.sell_date, r.shares, r.gross, r.net, r.exit_reason) for r in both if r.account == n} == set(trades)


def test_opposite_sides_on_one_signal(spark):
    """Two accounts take one signal on opposite sides, whatever the order of the rows."""
    bars, _ = made(3)
    days = sorted({x["trade_date"] for x in bars})
    have = {(x["symbol"], x["trade_date"]) for x in bars}
    first = next(x for x in bars if (x["symbol"], days[days.index(x["trade_date"]) + 1]) in have)
    rows = [Row(account=n, signal_date=first["trade_date"], market=first["market"], symbol=first["symbol"], rank=1, score=1.0, direction=d) for n, d in (("x", "LONG"), ("y", "SHORT"))]
    b = spark.createDataFrame([Row(**{**x, "is_limit_up": 0, "is_limit_down": 0, "is_suspended": 0}) for x in bars], BARS)
    for order in (rows, rows[::-1]):
        assert {(r.account, r.direction) for r in bt.simulate(spark.createDataFrame(order, SIGNALS), b).collect()} == {("x", "LONG"), ("y", "SHORT")}


def test_parameters_of_a_configuration():
    a = account_of({"backtest": {"top": 3}, "exit_rules": {"technical": {"take_profit_atr": 4}, "max_hold": {"max_days": 12, "min_days": 2}, "signal_exit": {"exit_when_score_below": 50}}, "stop_loss": {"method": "chandelier", "chandelier": {"multiplier": 2.5}, "trailing": {"enabled": True, "pullback_pct": 0.07}, "volatility_adaptive": {"high_volatility_threshold": 0.4, "high_volatility_multiplier": 3}}}, 8)
    assert (a.max_positions, a.hold_days, a.max_hold_days, a.min_hold_days) == (3, 8, 12, 2)
    assert (a.stop_loss, a.stop_atr, a.chandelier, a.trailing, a.profit_atr, a.score_below) == (None, 2.5, 2.5, 0.07, 4.0, 50.0) and a.high_volatility == (0.4, 3.0) and a.low_volatility is None
    assert account_of({}) == bt.Account(max_hold_days=5) and account_of({"exit_rules": {"enabled": False}}).stop_loss == 0.08
    assert bt.Account() == bt.Account(cash=1e6, max_positions=5, hold_days=5, hard_stop=0.12, stop_loss=0.08, take_profit=None, atr_share=0.02, margin_rate=0.5)


def test_no_signals(spark):
    bars, signals = made(2)
    b = spark.createDataFrame([Row(**x) for x in bars], BARS)
    assert bt.ledger(spark.createDataFrame([], SIGNALS), b).count() == 0
    late = [Row(**{**signals[0], "signal_date": max(x["trade_date"] for x in bars)})]
    assert bt.ledger(spark.createDataFrame(late, SIGNALS), b).count() == 0  # no market day follows


def test_configurations_equal_single_walks(spark):
    """A grid of whole configurations against one walk for each of them."""
    bars, signals = made(11)
    own = [{k: v for k, v in s.items() if k not in ("account", "direction")} | {"amount_ma20": 1e6 * (1 + s["rank"])} for s in signals if s["account"] == "x"]
    b = spark.createDataFrame([Row(**x) for x in bars], BARS)
    s = spark.createDataFrame([Row(**x) for x in own], "signal_date date, market string, symbol string, rank int, score double, amount_ma20 double")
    configs = rs.configurations({"backtest": {"top": 2}, "exit_rules": {"max_hold": {"min_days": 1}}}, {"backtest.hold_days": [4, 8], "strategy.min_score": [0, 65], "exit_rules.technical.stop_loss_atr": [None, 2.0]})
    assert len(configs) == 8 and configs[1]["strategy"]["min_score"] == 65 and "strategy" not in {"backtest": {"top": 2}}
    got = {r.combination: r for r in rs.run_configurations(s, b, configs).collect()}
    for i, c in enumerate(configs):
        a = account_of(c, c["backtest"]["hold_days"])
        kept = []
        for day in {x["signal_date"] for x in own}:
            fit = sorted((x for x in own if x["signal_date"] == day and x["score"] >= c["strategy"]["min_score"]), key=lambda x: x["rank"])
            kept += [x | {"direction": "LONG"} for x in fit[:2]]
        trades, marks = walk(kept, bars, a)
        closed = [t for t in trades if t[5] is not None]
        equity = [marks[d][0] for d in sorted(marks)]
        peaks = [max([a.cash, *equity[: j + 1]]) for j in range(len(equity))]
        assert got[i].trades == len(closed) and got[i].periods == len(marks) and got[i].empty == sum(m[2] == 0 and m[3] == 0 for m in marks.values())
        assert got[i].total_return == pytest.approx(equity[-1] / a.cash - 1, abs=2e-6) and got[i].max_drawdown == pytest.approx(min(e / p - 1 for e, p in zip(equity, peaks)), abs=2e-6)
        assert got[i].win_rate == pytest.approx(sum(t[8] > 0 for t in closed) / len(closed) if closed else 0.0, abs=2e-6)
    scores = [r.research_score for r in sorted(got.values(), key=lambda r: r.place)]
    assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        rs.configurations({}, {"backtest.top": []})
