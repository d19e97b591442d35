import re

from pyspark.sql import functions as F

from barloom import stored
from barloom.operators import indicators
from barloom.operators.cross_section import quality
from barloom.plans import accounts, backtest_queries, catalog, factor_queries, strategy_queries
from barloom.sources.bars import adjustment_factors, build_raw_daily, raw_daily


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan(df)))


def test_windows_and_joins_need_no_exchange(spark, sf_dir):
    raw, adj, f = raw_daily(spark, sf_dir), factor_queries.adjusted(spark, sf_dir), factor_queries.all_factors(spark, sf_dir)
    assert exchanges(indicators.factors(adj)) == 0  # all rolling frames
    assert exchanges(indicators.recursive(f)) == 0
    assert exchanges(quality(f)) == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = catalog.stock_view(raw, adj, f, ["ma20"])
        assert "SortMergeJoin" in plan(view) and exchanges(view) == 0
        assert exchanges(build_raw_daily(spark, sf_dir)) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_stored_table_is_built_once_and_equals_its_build(spark, sf_dir):
    raw = raw_daily(spark, sf_dir)
    assert raw.exceptAll(build_raw_daily(spark, sf_dir)).isEmpty() and build_raw_daily(spark, sf_dir).exceptAll(raw).isEmpty()
    calls = []
    source = f"{sf_dir}/lineitem.parquet"
    make = lambda: calls.append(1) or raw.limit(10)
    a = stored.stored(spark, source, "once", make)
    b = stored.stored(spark, source, "once", make)
    assert len(calls) == 1 and a.count() == b.count() == 10


def test_a_changed_input_is_built_anew(spark, sf_dir, tmp_path):
    row = raw_daily(spark, sf_dir).limit(3)
    row.write.parquet(str(tmp_path / "in"))
    build = lambda: spark.read.parquet(str(tmp_path / "in"))
    assert stored.stored(spark, str(tmp_path / "in"), "changing", build).count() == 3
    row.write.mode("append").parquet(str(tmp_path / "in"))
    assert stored.stored(spark, str(tmp_path / "in"), "changing", build).count() == 6


def test_empty_tables_are_stored(spark, sf_dir, tmp_path):
    empty = raw_daily(spark, sf_dir).where("false")
    stored.write_bucketed(empty, "barloom_empty_test", str(tmp_path / "e"))
    t = spark.table("barloom_empty_test")
    assert t.count() == 0 and indicators.factors(factor_queries.adjust(t, adjustment_factors(t))).select(F.count("*")).first()[0] == 0


def test_indicators_are_computed_from_narrow_sorted_bars(spark, sf_dir):
    for name in ("factor_rsi", "factor_macd", "strategy_mean_reversion"):
        factor_queries.adjusted(spark, sf_dir)
        p = plan((factor_queries.QUERIES | strategy_queries.QUERIES)[name](spark, sf_dir))
        scanned = re.findall(r"FileScan parquet spark_catalog\.default\.barloom_(\w+?)_[0-9a-f]{16}", p)
        assert scanned and set(scanned) == {"adj_qfq_factor"}  # no table of all indicators
        assert p.count("Sort [market") == 0  # a bucket is one sorted file
    assert len(re.findall(r"\bExchange\b", plan(build_raw_daily(spark, sf_dir)))) == 1


def test_buckets_follow_the_input(spark, sf_dir, monkeypatch):
    path = f"{sf_dir}/lineitem.parquet"
    size = sum(f.getLen() for f in stored.input_files(spark, path))
    assert stored.bucket_count(spark, path) == 4
    monkeypatch.setattr(stored, "BUCKET_BYTES", -(-size // 9))
    assert stored.bucket_count(spark, path) == 9
    assert build_raw_daily(spark, sf_dir).exceptAll(raw_daily(spark, sf_dir)).isEmpty()


def test_stored_bars_are_adjusted_where_they_lie(spark, tmp_path):
    days = spark.range(3000).selectExpr("'sh' as market", "lpad(cast(id % 7 as string), 6, '0') as symbol", "date_add(date'2020-01-01', cast(id div 7 as int)) as trade_date", "2020 as trade_year", "10.0D as open", "12.0D as high", "9.0D as low", "11.0D as close", "1000L as volume", "11000.0D as amount")
    stored.write_bucketed(days, "barloom_adjust_in_place", str(tmp_path / "raw"), 9)  # more buckets than the session's partitions
    raw = spark.table("barloom_adjust_in_place")
    adj = factor_queries.adjust(raw, adjustment_factors(raw))
    assert exchanges(adj) == 0 and exchanges(adj.repartition(9, *stored.BUCKET)) == 0
    loose = spark.read.parquet(str(tmp_path / "raw"))  # the same rows without buckets
    dealt = factor_queries.adjust(loose, adjustment_factors(loose))
    assert exchanges(dealt) == 1
    assert adj.count() == 3000 and adj.exceptAll(dealt).isEmpty() and dealt.exceptAll(adj).isEmpty()
    assert adj.select("adj_factor").distinct().count() > 2


def test_signals_are_picked_once_and_only_their_instruments_are_walked(spark, sf_dir):
    for name in ("backtest_match", "stateful_equity"):
        p = plan(backtest_queries.QUERIES[name](spark, sf_dir))
        assert "WindowGroupLimit [trade_date" not in p  # signals are read
        assert "FlatMapGroupsInPandas" not in p  # accounts are walked before, once
    bars = backtest_queries.bars(spark, sf_dir)
    some = spark.createDataFrame([("sh", "000003")], "market string, symbol string")
    own = accounts.bars_of(some, bars)
    tree = own._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: [i for i, line in enumerate(tree) if re.match(rf"[\s:+|-]*{word}\b", line)]
    assert min(depth("Window")) < min(depth("Join LeftSemi"))  # other instruments go before the means
    assert own.exceptAll(bars.where("symbol = '000003' and market = 'sh'")).isEmpty() and own.count() == bars.where("symbol = '000003' and market = 'sh'").count() > 0
