import datetime as dt

import numpy as np
import pytest
from pyspark.errors import ParseException
from pyspark.sql import Row
from pyspark.sql import functions as F

from barloom.plans import backtest as bt
from barloom.plans import catalog as ct
from barloom.plans import portfolio as pf
from barloom.plans import research as rs
from barloom.plans import risk
from barloom.plans import strategies as st

NUMBERS = ["adj_close", "ma5", "ma20", "ma60", "ret_5", "ret_20", "ret_60", "amount_ma20", "pos_20", "pos_60", "dd_20", "vol_ratio_20", "rsi_14", "atr_pct_14", "vol_20", "bb_lower_20", "std_pctchg_20", "vol_ratio_5_60", "price_vol_corr_20", "atr_pct_14_pct_rank", "pct_rank_ret_20", "vol_20_pct_rank", "amount_ma20_pct_rank", "rs_score", "risk_score"]
#: An instrument in an even rise.
RISING = {"adj_close": 27.4, "ma20": 25.1, "ma60": 22.3, "ret_5": 0.017, "ret_20": 0.094, "ret_60": 0.153, "amount_ma20": 243e6, "pos_20": 0.77, "pos_60": 0.66, "dd_20": -0.045, "vol_ratio_20": 0.13, "rsi_14": 57.5, "atr_pct_14": 0.023, "vol_20": 0.017}


def factor_row(spark, **values):
    schema = "market string, symbol string, trade_date date, " + ", ".join(f"{c} double" for c in NUMBERS)
    return spark.createDataFrame([("sh", "600519", dt.date(2024, 1, 2), *[values.get(c) for c in NUMBERS])], schema)


def test_component_values(spark):
    """Worked out by hand from the formulas of the components."""
    p = st.Params(min_amount_ma20=40e6)
    # trend: 15 + 10 + 10 * 0.08 / 0.20; breakout: 20 * (0.72 + 0.54) / 1.8 + 10 * 0.15 / 0.5
    # low volatility: 20 * (1 - 0.02 / 0.08); liquidity: 20 * 120 / 200; penalty: dd_20 at or over -0.03
    row = {"adj_close": 33.0, "ma20": 30.0, "ma60": 27.0, "ret_5": 0.01, "ret_20": 0.08, "amount_ma20": 120e6, "pos_20": 0.72, "pos_60": 0.54, "dd_20": -0.02, "vol_ratio_20": 0.15, "rsi_14": 55.0, "atr_pct_14": 0.02, "vol_20": 0.015}
    got = st.scored(factor_row(spark, **row), "low_vol_breakout", p).first()["score_breakdown"]
    assert got == {"trend": 29.0, "breakout": 17.0, "low_volatility": 15.0, "liquidity": 12.0, "risk_penalty": -2.0}
    # oversold: 25 * (30 - 24) / 10 + 15 * 0.03 / 0.15; band: 20 * 1 / 19 + 0; penalty: +2 under 30
    low = {"adj_close": 18.0, "ma20": 21.0, "ma60": 25.0, "std_pctchg_20": 0.06, "ret_20": -0.18, "rsi_14": 24.0, "amount_ma20": 80e6, "bb_lower_20": 19.0, "atr_pct_14": 0.02, "vol_20": 0.02}
    got = st.scored(factor_row(spark, **low), "mean_reversion", p).first()["score_breakdown"]
    assert (got["trend"], got["oversold"], got["band_reclaim"], got["liquidity"], got["risk_penalty"]) == (0.0, 18.0, 1.05, 8.0, 2.0)


def test_multi_factor_and_nulls(spark):
    row = {"pct_rank_ret_20": 0.8, "vol_20_pct_rank": 0.1, "amount_ma20_pct_rank": 0.7, "rs_score": 0.75, "adj_close": 27.4, "ma20": 25.1, "ma60": 22.3}
    got = st.scored(factor_row(spark, **row), "multi_factor").first()["score_breakdown"]
    assert got["momentum"] == pytest.approx(0.32) and got["volatility"] == pytest.approx(-0.27)
    empty = st.scored(factor_row(spark), "trend_strength").first()
    assert (empty["reason"], empty["status"], empty["score_breakdown"]["trend"]) == ("missing_required_factor", "excluded", 0.0)


@pytest.mark.parametrize(("change", "reason"), [({"amount_ma20": 1.0}, "insufficient_liquidity"), ({"ret_5": 0.2}, "overheated_ret_5"), ({"rsi_14": 90.0}, "extreme_rsi"), ({"vol_20": 0.09}, "excessive_volatility"), ({"ma60": None}, "missing_required_factor")])
def test_exclusions(spark, change, reason):
    assert factor_row(spark, **(RISING | change)).select(st.exclusion(st.Params()).alias("r")).first()["r"] == reason


def test_one_pass_equals_single_strategies(spark):
    rows = [factor_row(spark, **(RISING | {"ret_20": 0.1 + i / 100})).withColumn("symbol", F.lit(f"60000{i}")) for i in range(4)]
    f = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    every = {(r["strategy"], r["symbol"], r["rank"], r["score"]) for r in st.all_picks(f, ["trend_strength", "relative_strength"]).collect()}
    single = {(n, r["symbol"], r["rank"], r["score"]) for n in ("trend_strength", "relative_strength") for r in st.picks(f, n).collect()}
    assert every == single and every


@pytest.mark.parametrize("sql", ["create table x as select 1", "select 1; select 2", "", "-- nothing", "select * from read_parquet('x')", "select * from parquet.`/x`", "select * from csv.`x`", "with a as (select 1) insert into t select * from a"])
def test_guard_rejects(sql):
    with pytest.raises(ValueError):
        ct.check_read_only(sql)


def test_guard_and_limit(spark):
    assert ct.check_read_only("SELECT 1 -- drop\n;") == "SELECT 1"
    assert ct.check_read_only("select 'drop; limit' as x")
    assert ct.has_top_limit("select 1 limit 5") and not ct.has_top_limit("select * from (select 1 limit 5) t") and not ct.has_top_limit("select 'limit'")
    with pytest.raises(PermissionError):
        ct.run_sql(spark, "select 1")
    assert ct.run_sql(spark, "select id from range(500)", 7, unsafe_sql=True).count() == 7
    assert ct.run_sql(spark, "select id from range(500) limit 9", 7, unsafe_sql=True).count() == 9
    df = spark.createDataFrame([Row(market="sh", symbol="1", trade_date=dt.date(2024, 1, i), trade_year=2024, close=float(i)) for i in range(1, 6)])
    with pytest.raises(ValueError):
        ct.select(df, ["nope"])
    with pytest.raises(ValueError):
        ct.select(df, limit=0)
    assert [r["close"] for r in ct.select(df, ["close"], start="2024-01-02", end="2024-01-04", desc=True, limit=2).collect()] == [4.0, 3.0]


def bars(spark, opens, **flags):
    rows = [("sh", "600000", dt.date(2024, 1, 2 + i), i + 1, o, o + 1, o - 1, o, flags.get("up", {}).get(i, 0), flags.get("down", {}).get(i, 0), 0, o - 1, 1.0) for i, o in enumerate(opens)]
    return spark.createDataFrame(rows, "market string, symbol string, trade_date date, rn long, o double, h double, l double, c double, is_limit_up int, is_limit_down int, is_suspended int, m20 double, a14 double")


def signal(spark):
    return spark.createDataFrame([(dt.date(2024, 1, 2), "sh", "600000", 1, 90.0, ["rsi_high"])], "signal_date date, market string, symbol string, rank long, score double, risk_flags array<string>")


def test_matching(spark):
    t = bt.trades(signal(spark), bars(spark, [10.0, 10.0, 11.0, 12.0, 13.0]), hold=2).first()
    assert (t["buy_price"], t["sell_price"], t["exit_reason"], t["skipped"]) == (10.0, 12.0, "max_holding_days", None)
    assert bt.trades(signal(spark), bars(spark, [10.0, 10.0, 11.0, 12.0], up={1: 1}), hold=2).first()["skipped"] == "limit_up/suspended"
    assert bt.trades(signal(spark), bars(spark, [10.0]), hold=2).first()["skipped"] == "missing_price"
    assert bt.trades(signal(spark), bars(spark, [10.0, 10.0, 11.0, 12.0], down={3: 1}), hold=2).first()["skipped"] == "missing_price"


def test_equity_and_drawdown(spark):
    p = spark.createDataFrame([(dt.date(2024, 1, i + 1), r, 1) for i, r in enumerate([0.1, -0.5, 0.2])], "signal_date date, r double, n long")
    e = bt.drawdown(bt.equity(p)).orderBy("signal_date").collect()
    assert [r["equity"] for r in e] == [1.1, 0.55, 0.66]
    assert min(r["drawdown"] for r in e) == -0.5


def test_simulation(spark):
    assert bt.shares(260_000, 12.3, 1e6, 5) == 16_200
    t = bt.simulate(signal(spark), bars(spark, [10.0, 10.0, 8.9, 8.5])).collect()
    assert [(r["buy_price"], r["sell_price"], r["exit_reason"], r["shares"]) for r in t] == [(10.0, 8.9, "stop_loss", 20000)]


def test_monte_carlo_moments(spark):
    r = bt.monte_carlo(spark, [0.01, -0.01, 0.02], 500).first()
    assert r["iterations"] == 500 and r["total_p05"] <= r["total_p50"] <= r["total_p95"] and r["dd_p95"] <= 0


def portfolio(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), "sh", s, sc, 0.0, a, []) for d, s, sc, a in rows], "trade_date date, market string, symbol string, score double, risk_score double, amount_ma20 double, risk_flags array<string>")


def test_weights_and_caps(spark):
    p = portfolio(spark, [(1, "a", 80.0, 1e9), (1, "b", 20.0, 1e9), (1, "c", 0.0, 1e9), (1, "d", 0.0, 1e9)])
    assert {r["symbol"]: r["weight"] for r in pf.weights(p, "score").collect()} == {"a": 0.8, "b": 0.2, "c": 0.0, "d": 0.0}
    zero = pf.weights(p.withColumn("score", F.lit(0.0)), "score")
    assert {r["weight"] for r in zero.collect()} == {0.25}
    capped = {r["symbol"]: r["weight"] for r in pf.cap_and_redistribute(pf.weights(p, "score"), 0.5).collect()}
    assert capped["a"] == pytest.approx(0.5) and capped["b"] == pytest.approx(0.5) and sum(capped.values()) == pytest.approx(1)


def test_rebalance_actions_and_costs(spark):
    p = portfolio(spark, [(1, "a", 10.0, 1e9), (1, "b", 20.0, 1e6), (2, "a", 15.0, 1e9), (2, "c", 15.0, None)])
    plan = pf.rebalance(pf.weights(p, "score"))
    assert {r["symbol"]: r["action"] for r in plan.collect()} == {"a": "INCREASE", "b": "SELL", "c": "BUY"}
    assert {r["symbol"]: r["action"] for r in pf.rebalance(pf.weights(p, "score"), paused=F.lit(True)).collect()}["c"] == "HOLD_CASH"
    assert {r["symbol"]: r["cost_level"] for r in pf.trade_costs(plan).collect()} == {"a": "low", "b": "critical", "c": "unknown"}
    assert pf.slices(plan).count() == 12


def test_account_exits_shorts_and_marks(spark):
    a = bt.Account(cash=1e6, max_positions=2, hold_days=3, take_profit=0.15, hard_stop=0.2, fee=0.0, slip=0.0)
    up = bars(spark, [10.0, 10.0, 11.0, 12.0, 12.0, 12.0])
    s = signal(spark)
    t = bt.simulate(s, up, a).first()
    assert (t["sell_price"], t["exit_reason"], t["shares"], t["net"]) == (12.0, "take_profit", 50_000, 0.2)
    short = bt.simulate(s.withColumn("direction", F.lit("SHORT")), up, a).first()
    assert (short["exit_reason"], short["sell_price"], short["gross"]) == ("hold_days", 12.0, round(10 / 12 - 1, 6))
    held = bt.simulate(s, up, bt.Account(hold_days=99, take_profit=None, hard_stop=None))
    assert held.first()["sell_date"] is None
    marks = {r["trade_date"].day: r["equity"] for r in bt.marked_equity(bt.simulate(s, up, a), up, a).collect()}
    assert marks == {2: 1e6, 3: 1e6, 4: 1.05e6, 5: 1.1e6, 6: 1.1e6, 7: 1.1e6}
    trail = bt.simulate(s, bars(spark, [10.0, 10.0, 13.0, 11.0, 11.0]), bt.Account(take_profit=None, trailing=0.2)).first()
    assert (trail["exit_reason"], trail["sell_price"]) == ("trailing_take_profit", 11.0)  # 11 is under 14 * 0.8
    stuck = bt.simulate(s, bars(spark, [10.0, 10.0, 7.0, 6.0], down={2: 1}), a).first()
    assert (stuck["exit_reason"], stuck["sell_price"]) == ("hard_stop_loss", 6.0)
    two = s.withColumn("account", F.explode(F.array(F.lit("x"), F.lit("y"))))
    assert {r["account"] for r in bt.simulate(two, up, a).collect()} == {"x", "y"}


def test_near_high_names_are_trimmed(spark):
    rows = [(dt.date(2024, 1, 1), "sh", s, sc, 0.1, 1e12, flags) for s, sc, flags in (("a", 90.0, ["near_20d_high"]), ("b", 80.0, ["near_20d_high"]), ("c", 70.0, []), ("d", 60.0, []))]
    p = spark.createDataFrame(rows, "trade_date date, market string, symbol string, score double, risk_score double, amount_ma20 double, risk_flags array<string>")
    got = {r["symbol"]: r["weight"] for r in pf.trim_near_high(p, "equal", max_weight=1.0).collect()}
    assert got["b"] is None and [round(got[s], 6) for s in "acd"] == [0.333333] * 3
    assert pf.constrained(np.array([0.5, 0.3, 0.2]), np.array([np.nan, 1e9, 1e9]), 0.4, 0.0, (1e7, 0.1, 3.0)).round(6).tolist() == [0.4, 0.36, 0.24]


@pytest.mark.parametrize("sql", ["select count(*) from `parquet`.`/x`", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select * from xml.`/x`", "select `java_method`('a', 'b')", "select * from (select * from orc.`/y`)", "with a as (select * from text.`/z`) select * from a", "select (select max(x) from nowhere)"])
def test_sql_reads_registered_views_alone(spark, sql):
    with pytest.raises(ValueError):
        ct.run_sql(spark, sql, unsafe_sql=True)


#: Statements that once got through, and their kin.
SNEAKY = [
    "with x as (select 1), `text, /etc/hostname` as (select 2) select * from `text`.`/etc/hostname`",
    "with a as (select '\\'), b as (select * from text.`/etc/hostname`) select * from b -- '",
    "select * from some_view where x in (select value from text.`/etc/hostname`)",
    "select x, (select max(value) from text.`/etc/hostname`) from some_view",
    "select * from some_view join lateral (select * from text.`/etc/hostname`) t",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from text.`/etc/hostname`",
    "select * from some_view order by (select max(value) from text.`/etc/hostname`)",
    "with a as (select * from b), b as (select 1) select * from a",
    "select * from (with inner_one as (select 1) select * from inner_one) t, inner_one",
    "select * from identifier('text.`/etc/hostname`')",
    "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "select transform(x) using 'cat /etc/hostname' as (y string) from some_view",
    "select * from spark_catalog.default.some_view",
    "select * from some_view version as of 1",
    "select spark_catalog.default.f(x) from some_view",
    "select * from some_view lateral view reflect('a', 'b') t as y",
    "select * from some_view where exists (select 1 from json.`/x`)",
    "select x from some_view union all select value from text.`/etc/hostname`",
    "select try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "select from_protobuf(x, 'm', '/etc/hostname') from some_view",
    "select * from secret_fn(1)",
    "table text.`/etc/hostname`",
]


@pytest.mark.parametrize("sql", SNEAKY)
def test_guard_judges_the_plan(spark, sql):
    ct.register_views({"some_view": spark.range(5).toDF("x")})
    with pytest.raises((ValueError, ParseException)):
        ct.check_relations(spark, sql)


@pytest.mark.parametrize(("sql", "n"), [("with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r", 3), ("select * from some_view where x in (select x from Some_View where x > 3)", 1), ("with `text, /x` as (select 2 as y) select * from `text, /x`", 1), ("select t.y from some_view lateral view explode(array(x, x)) t as y", 10), ("select x, count(*) over w as n from some_view window w as (order by x)", 5), ("select * from values (1), (2) as t(a) intersect select 1", 1), ("select * from some_view pivot (count(*) for x in (1, 2))", 1), ("select /*+ broadcast(b) */ a.x from some_view a join some_view b using (x) where a.x between 1 and 2 group by a.x having count(*) > 0", 2), ("select x from some_view tablesample (100 percent)", 5), ("select 'from text.`/x`' as s, x from some_view order by x limit 2", 2)])
def test_guard_lets_queries_pass(spark, sql, n):
    ct.register_views({"some_view": spark.range(5).toDF("x")})
    assert ct.run_sql(spark, sql, unsafe_sql=True).count() == n


@pytest.mark.parametrize("expr", ["x > (select 1)", "", "x; y", "reflect('a', 'b') = 'c'", "exists(select 1)", "a.b.f(x)"])
def test_expression_guard(spark, expr):
    with pytest.raises((ValueError, ParseException)):
        ct.check_expression(expr, spark)


def test_table_functions(spark):
    rows = [("sz", "000001", dt.date(2024, 1, i), float(i)) for i in range(2, 9)] + [("sh", "000001", dt.date(2024, 1, i), -float(i)) for i in range(2, 5)]
    ct.register_views({"adj_daily": spark.createDataFrame(rows, "market string, symbol string, trade_date date, adj_close double")})
    ct.register_macros(spark)
    got = lambda args: sorted(r.adj_close for r in ct.run_sql(spark, f"SELECT * FROM last_n_days({args})", unsafe_sql=True).collect())
    assert got("'sz000001', 2") == [7.0, 8.0] and got("'000001.SH', 2") == [-4.0, -3.0] and got("'000001', 1") == [-4.0, 8.0]
    assert got("'000001', 9, 'SH'") == [-4.0, -3.0, -2.0] and got("'600000', 5") == [] and got("'sz000001', 0") == []
    assert ct.run_sql(spark, "select symbol_code('600519.SH') || symbol_market('sz000001') as x", unsafe_sql=True).first().x == "600519sz"


def test_sql_over_views(spark):
    ct.register_views({"some_view": spark.range(5).toDF("x")})
    assert ct.run_sql(spark, "with a as (select x from some_view where x > 1), b as (select * from a) select count(*) as n from b join some_view using (x)", unsafe_sql=True).first()["n"] == 3


def test_conditions_and_state(spark):
    df = spark.createDataFrame([("a", 0.7, "up", None), ("b", 0.5, "down", 1.0)], "k string, market_breadth double, trend string, credit double")
    rows = {r["k"]: r for r in df.select("k", risk.condition("market_breadth >= 0.6", df.columns).alias("x"), risk.condition("trend == 'up'", df.columns).alias("y"), risk.condition("credit > 0", df.columns).alias("z"), risk.condition("no such", df.columns).alias("n")).collect()}
    assert (rows["a"]["x"], rows["a"]["y"], rows["a"]["z"], rows["a"]["n"]) == (True, True, None, None) and (rows["b"]["x"], rows["b"]["z"]) == (False, True)
    state = lambda **o: {r["k"]: (r["status"], r["action"]) for r in risk.market_state(df, **o).collect()}
    assert state() == {"a": ("bull", "allow_open"), "b": ("neutral", "reduce_position")}
    assert state(bull=["credit > 0"])["a"] == ("not_available", "pause_open") and state(required=["credit"])["a"][0] == "not_available"
    with pytest.raises(ValueError):
        risk.gate_target("strategy", {"risk_filter_applied": True})
    assert risk.overrides({"high_volatility_mode": {"max_sector": 0.1, "x": 1}}, "bear", "") == {"max_sector_weight": 0.1}
    assert rs.with_overrides({"a": {"b": 1}}, {"a.c": 2, "d.e": 3}) == {"a": {"b": 1, "c": 2}, "d": {"e": 3}}
    assert rs.grid(spark, {"x": [1, 2], "y": ["p"]}).count() == 2


def test_pre_filter_rules(spark):
    df = spark.createDataFrame([("a", 5.0, ["st"], 10, None), ("b", 50.0, [], 500, 0.9), ("c", 50.0, [], None, -0.1)], "symbol string, close double, tags array<string>, listing_days int, max_drawdown double")
    got = {r["symbol"]: [x["rule"] for x in r["broken"]] for r in st.pre_filter(df, {"basic": {"min_price": 6, "min_listing_days": 60}, "max_drawdown": 0.5, "required_fields": ["listing_days"]}).collect()}
    assert got == {"a": ["exclude_st", "min_listing_days", "min_price"], "b": ["max_drawdown"], "c": ["required_fields"]}
    assert st.pre_filter(df, {"exclude_st": False}).where("size(broken) > 0").count() == 0


def test_execution_orders(spark):
    plan = spark.createDataFrame([(dt.date(2024, 1, 1), "sh", "a", 0.4, 1e6, "BUY"), (dt.date(2024, 1, 1), "sh", "b", -0.1, 1e8, "SELL"), (dt.date(2024, 1, 1), "sh", "c", 0.0, 1e8, "HOLD"), (dt.date(2024, 1, 2), "sh", "d", 0.2, None, "BUY")], "trade_date date, market string, symbol string, delta double, adv double, action string")
    count = lambda **o: pf.execution_orders(plan, **o).where("symbol = 'a'").count()
    assert (count(), count(method="pov", slices=0), count(method="PoV", slices=0, participation=0.2), count(method="close"), count(slices=7)) == (4, 6, 4, 1, 7)
    rows = {r["symbol"]: r for r in pf.execution_orders(plan, "twap", 2, piecewise=pf.PIECEWISE).collect()}
    assert (rows["a"].delta, rows["a"].adv_share, rows["a"].cost_level, rows["a"].impact_bps, rows["a"].reject) == (0.2, 4.0, "critical", 112.0, True)
    assert (rows["b"].cost_level, rows["b"].impact_bps, rows["b"].reject, rows["d"].adv_share) == ("medium", 13.16, False, 0.0)
    assert {r.trade_date.day: (r.slices, r.rejected, r.impact_bps, r.batched) for r in pf.execution_summary(pf.execution_orders(plan, "close", piecewise=pf.PIECEWISE)).collect()} == {1: (2, 1, 62.58, True), 2: (1, 0, 8.0, False)}


def test_days_to_sell(spark):
    w = spark.createDataFrame([("a", 0.5, 1e7), ("b", 0.1, 1e7), ("c", 0.1, None), ("d", 0.1, 0.0)], "symbol string, weight double, amount_ma20 double").selectExpr("date'2024-01-01' as trade_date", "'sh' as market", "*")
    got = {r["symbol"]: (r.days_to_sell, r.weight_cap, r.status) for r in pf.liquidity(w, 1e7, 0.1, 3.0).collect()}
    assert got == {"a": (5.0, 0.3, "exceeds_liquidation_days"), "b": (1.0, 0.3, "pass"), "c": (None, None, "no_adv_data"), "d": (None, None, "no_adv_data")}
    assert {r.status for r in pf.liquidity(w, 0.0).collect()} == {"no_adv_data"}


def test_trimming_is_dealt_over_tasks_and_equals_the_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), "sh", f"{i:02d}", float(rng.integers(60, 64)), [0.1, None][i == 3], [float(rng.integers(1, 9)) * 1e7, None][i == 5], [["near_20d_high"], [], None][min(2, int(rng.integers(0, 5)) // 2)]) for d in range(30) for i in range(12)]
    p = spark.createDataFrame(rows, "trade_date date, market string, symbol string, score double, risk_score double, amount_ma20 double, risk_flags array<string>")
    got = pf.trim_near_high(p, "hybrid")
    assert got.rdd.getNumPartitions() > 4  # small picks are not handed to one task
    found = {(r["trade_date"], r["symbol"]): r["weight"] for r in got.collect()}
    dropped = 0
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[2])
        while own:
            score, calm = np.array([r[3] for r in own]), np.array([1 - (r[4] or 0.0) for r in own])
            adv = np.array([max(r[5] or 0.0, 1.0) for r in own])
            w = pf.constrained(pf.base_weights(score, calm, adv, "hybrid"), np.array([r[5] if r[5] else np.nan for r in own]), 0.1, 0.0, (1e7, 0.1, 3.0))
            high = [r for r in own if "near_20d_high" in (r[6] or [])]
            if not high or sum(x for x, r in zip(w, own, strict=True) if r in high) <= 0.4 + 1e-15:
                break
            own.remove(min(high, key=lambda r: (r[3], r[2])))
        kept = {r[2]: x for r, x in zip(own, w, strict=True)}
        for r in (r for r in rows if r[0] == d):
            x = found[d, r[2]]
            dropped += r[2] not in kept
            assert x is None and r[2] not in kept or x == pytest.approx(kept[r[2]], abs=1e-11)
    assert dropped and len(found) == len(rows)
