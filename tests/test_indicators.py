import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.operators.adjust import adjust
from barloom.operators.cross_section import cross_section, quality

BAR = "market string, symbol string, trade_date date, trade_year int, open double, high double, low double, close double, volume long, amount double"
ADJ = "market string, symbol string, trade_date date, trade_year int, adj_open double, adj_high double, adj_low double, adj_close double, volume long, amount double, adj_factor double"


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def linear(spark, n, first=10.0):
    rows = [("sh", "600519", d, d.year, first + i, first + i + 1, first + i - 1, first + i, 1000, 1000.0 * (first + i), 1.0) for i, d in enumerate(days(n))]
    return spark.createDataFrame(rows, ADJ)


def test_as_of_dense_and_sparse(spark):
    raw = spark.createDataFrame([("sh", "600000", dt.date(2024, 1, 2), 2024, 10.0, 10.0, 10.0, 10.0, 100, 1000.0), ("sh", "600000", dt.date(2024, 1, 5), 2024, 5.0, 5.0, 5.0, 5.0, 200, 1000.0)], BAR)
    factor = spark.createDataFrame([("sh", "600000", dt.date(2024, 1, 3), dt.date(2024, 1, 3), 0.5)], "market string, symbol string, trade_date date, start_date date, qfq_factor double")
    out = [(r.adj_close, r.volume, r.adj_factor) for r in adjust(raw, factor).orderBy("trade_date").collect()]
    assert out == [(10.0, 100, 1.0), (2.5, 400, 0.5)]
    dense = spark.createDataFrame([("sh", "600000", dt.date(2024, 1, 2), None, 0.5), ("sh", "600000", dt.date(2024, 1, 5), None, 0.0), ("sh", "600000", None, None, 9.0)], factor.schema)
    assert [(r.adj_close, r.volume) for r in adjust(raw, dense).orderBy("trade_date").collect()] == [(5.0, 200), (0.0, 200)]


def test_linear_series_closed_form(spark):
    f = indicators.factors(linear(spark, 25), states=True)
    last = f.orderBy(F.desc("trade_date")).first()
    assert last["ma120"] == pytest.approx(sum(10 + i for i in range(25)) / 25)
    assert last["atr_14"] == pytest.approx(2.0)
    assert last["rsi_14"] == 100.0
    assert (last["plus_di_14"], last["minus_di_14"], last["adx_14"]) == (pytest.approx(50.0), 0.0, 100.0)
    assert last["rsv_9"] == pytest.approx(90.0)
    assert last["vol_ratio_20"] == pytest.approx(0.0)
    k = d = 50.0
    for _ in range(17):
        k = 2 / 3 * k + 30
        d = 2 / 3 * d + k / 3
    assert (last["kdj_k"], last["kdj_d"], last["kdj_j"]) == (pytest.approx(k), pytest.approx(d), pytest.approx(3 * k - 2 * d))
    fast = slow = 10.0
    dea = 0.0
    for c in range(11, 35):
        fast, slow = 2 / 13 * c + 11 / 13 * fast, 2 / 27 * c + 25 / 27 * slow
        dea = 0.2 * (fast - slow) + 0.8 * dea
    assert (last["macd_dif"], last["macd_dea"]) == (pytest.approx(fast - slow, abs=1e-12), pytest.approx(dea, abs=1e-12))
    assert last["price_vol_corr_20"] is None


def test_extra_windows(spark):
    assert indicators.normalise_windows([30, 7, 20, 7]) == [7, 20, 30]
    with pytest.raises(ValueError):
        indicators.normalise_windows([0])
    row = indicators.extra_windows(indicators.base(linear(spark, 40, 20.0)), [7, 30]).orderBy(F.desc("trade_date")).first()
    assert all(row[f"{k}{n}"] is not None for n in (7, 30) for k in ("ma", "vol_ma", "ret_", "vol_", "high_", "low_", "range_", "dd_", "pos_", "bias_"))


def test_cross_section_and_quality(spark):
    a = linear(spark, 70)
    b = a.withColumns({"symbol": F.lit("600000"), "adj_close": F.col("adj_close") * 2})
    f = indicators.factors(a.unionByName(b))
    last = {r["symbol"]: r for r in cross_section(quality(f)).where("trade_date = date '2024-03-10'").collect()}
    assert last["600519"]["trade_day_count"] == 2
    assert {last[s]["rank_ret_20"] for s in last} == {1, 2}
    assert {last[s]["pct_rank_ret_20"] for s in last} == {0.0, 1.0}
    assert last["600519"]["quality_score"] == 100
    assert last["600000"]["invalid_ohlc_flag"] == 1 and last["600000"]["quality_score"] == 80


def test_states_in_one_pass_equal_those_of_their_own_pass(spark):
    bars = linear(spark, 30).union(linear(spark, 4, 50.0).withColumn("symbol", F.lit("600000")))
    x = indicators.technical(indicators.rolling(indicators.returns(indicators.base(bars))))
    key = ["market", "symbol", "trade_date"]
    one = indicators.with_states(x)
    picked = ["ma20", "rsi_14"]
    narrow = indicators.factors(bars, states=True, columns=picked).select(*key, *picked, *indicators.STATES)
    joined = indicators.factors(bars, states=True).select(narrow.columns)
    assert [tuple(r) for r in narrow.orderBy(*key).collect()] == [tuple(r) for r in joined.orderBy(*key).collect()]
    a = [tuple(r) for r in one.select(*key, *indicators.STATES).orderBy(*key).collect()]
    assert a == [tuple(r) for r in indicators.recursive(x).select(*key, *indicators.STATES).orderBy(*key).collect()]
    assert indicators.factors(bars, columns=picked).columns == [*key, *picked]
    assert len(a) == 34 and all(r[6] is None for r in a[:4])
    assert [tuple(r) for r in one.drop(*indicators.STATES).orderBy(*key).collect()] == [tuple(r) for r in x.orderBy(*key).collect()]
    assert indicators.with_states(x.limit(0)).count() == 0
