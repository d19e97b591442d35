import datetime as dt
import struct

import pytest

from barloom.operators import reconcile, versions
from barloom.sources import files
from barloom.sources.day_source import DayReader
from barloom.streaming import increments


def record(day, o, h, low, c, amount, volume):
    return struct.pack("<IIIIIfII", day, o, h, low, c, amount, volume, 0)


def test_day_files(spark, tmp_path):
    d = tmp_path / "sh" / "lday"
    d.mkdir(parents=True)
    good = record(20240102, 101, 123, 99, 111, 12345.0, 1000)
    (d / "sh600000.day").write_bytes(good + record(20240103, 102, 124, 100, 112, 1.0, 1) + b"\1\2\3")
    (d / "sh000001.day").write_bytes(good)
    (d / "notes.day").write_bytes(good)
    rows = files.day_files(spark, str(tmp_path), end="2024-01-02").collect()
    assert [(r.market, r.symbol, r.trade_date, r.open, r.high, r.low, r.close, r.amount, r.volume) for r in rows] == [("sh", "600000", dt.date(2024, 1, 2), 1.01, 1.23, 0.99, 1.11, 12345.0, 1000)]
    assert files.day_files(spark, str(tmp_path), universe="all").count() == 3
    assert files.day_files(spark, str(tmp_path), universe="all", limit_symbols=1).select("symbol").distinct().collect()[0][0] == "000001"
    with pytest.raises(ValueError):
        files.day_files(spark, str(tmp_path), universe="none")


def vipdoc(tmp_path, names):
    for i, n in enumerate(names):
        d = tmp_path / n[:2] / "lday"
        d.mkdir(parents=True, exist_ok=True)
        days = [20231229, 20240102, 20240103, 20240199, 20240105]
        (d / f"{n}.day").write_bytes(b"".join(record(x, 100 + i, 120 + i, 90, 110, 5.0 * j, j) for j, x in enumerate(days)) + b"tail")
    return str(tmp_path)


NAMES = ["sh600000", "sh600001", "sh000300", "sz000001", "sz300001", "bj430001"]


def test_conditions_prune_files_and_records(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, Not, StringStartsWith

    def reader(*filters, **options):
        r = DayReader({"path": vipdoc(tmp_path, NAMES), **options})
        return r, list(r.pushFilters(list(filters)))

    r, rest = reader(EqualTo(("market",), "sh"), Not(EqualTo(("symbol",), "600001")))
    assert len(r.files()) == 2 and len(rest) == 1  # Spark judges the Not
    assert [f.symbol for f in reader(In(("symbol",), ("000001", "600001")))[0].files()] == ["600001", "000001"]
    assert [f.symbol for f in reader(StringStartsWith(("symbol",), "0"), universe="all")[0].files()] == ["000300", "000001"]
    assert [f.market for f in reader(markets="sz,sh")[0].files()] == ["sz", "sz", "sh", "sh"]
    assert [f.symbol for f in reader(markets="sz,sh", limit_symbols="3")[0].files()] == ["000001", "300001", "600000"]
    assert reader(EqualTo(("symbol",), "600001"), markets="sz,sh", limit_symbols="3")[0].files() == []
    r, rest = reader(GreaterThanOrEqual(("trade_date",), dt.date(2024, 1, 2)), LessThan(("trade_date",), dt.date(2024, 1, 4)), EqualTo(("market",), "bj"))
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert rest == [] and [x["trade_date"].day for x in rows] == [2, 3] and rows[0]["volume"] == 1
    # Tasks by size: a record a task, a file a task, all in one.
    assert [len(reader(partition_bytes=n)[0].partitions()) for n in (32, 5 * 32, 10 * 32, 1 << 20)] == [25, 5, 3, 1]
    for n in (32, 64, 1 << 20):
        r, _ = reader(partition_bytes=n)
        assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 4 * 5  # the 99th of January is no day
    for bad in ({"markets": "xx"}, {"universe": "some"}):
        with pytest.raises(ValueError):
            reader(**bad)


def test_day_files_through_spark(spark, tmp_path):
    path = vipdoc(tmp_path, NAMES)
    df = files.day_files(spark, path, start="2024-01-01", universe="all", markets=("sz", "sh")).where("market = 'sh' and symbol like '600%' and volume > 1")
    assert "PushedFilters" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() == 1
    assert sorted((r.symbol, r.trade_date.day, r.trade_year) for r in df.collect()) == [(s, d, 2024) for s in ("600000", "600001") for d in (3, 5)]
    (tmp_path / "empty").mkdir()
    assert files.day_files(spark, str(tmp_path / "empty")).count() == 0


def test_export_files_and_names(spark, tmp_path):
    text = "600000 浦发银行 日线\r\n日期\t开\t高\t低\t收\t量\t额\r\n2024/01/02\t1\t2\t0.5\t1.5\t100.0\t1000\r\n02-01-2020\t1\t2\t0.5\t1.4\t7\t8\r\nshort\t1\r\n"
    (tmp_path / "SH#600000.txt").write_bytes(text.encode("gbk"))
    rows = {r.trade_date: (r.market, r.symbol, r.close, r.volume) for r in files.export_files(spark, str(tmp_path)).collect()}
    assert rows == {dt.date(2024, 1, 2): ("sh", "600000", 1.5, 100), dt.date(2020, 1, 2): ("sh", "600000", 1.4, 7)}
    assert files.stock_names(spark, str(tmp_path)).first()["name"] == "浦发银行"


def test_action_table_defaults(spark, tmp_path):
    p = tmp_path / "corporate_actions.csv"
    p.write_text("market,symbol,ex_date,cash_dividend\nsh,600000,2024-05-01,\n", encoding="utf-8-sig")
    r = files.action_table(spark, str(p)).first()
    assert (r.market, r.symbol, r.ex_date, r.cash_dividend, r.category, r.source) == ("sh", "600000", dt.date(2024, 5, 1), 0.0, 0, "")
    q = tmp_path / "adjustment_factors.csv"
    q.write_text("market,symbol,trade_date,qfq_factor\nsh,600000,2024-05-01,\n")
    assert files.action_table(spark, str(q)).first().qfq_factor == 1.0


def test_action_inputs(spark, tmp_path):
    none = {"corporate_actions": None, "adjustment_factors": None}
    assert files.action_inputs(spark, None) == none and files.action_inputs(spark, str(tmp_path)) == none
    for n in ("actions.csv", "corporate_actions.parquet", "factors.csv"):
        (tmp_path / n).write_text("market\n")
    assert files.action_inputs(spark, str(tmp_path)) == {"corporate_actions": f"{tmp_path}/actions.csv", "adjustment_factors": f"{tmp_path}/factors.csv"}
    assert files.action_inputs(spark, f"{tmp_path}/factors.csv")["adjustment_factors"] and files.action_inputs(spark, f"{tmp_path}/actions.csv")["corporate_actions"]
    with pytest.raises(FileNotFoundError):
        files.action_inputs(spark, f"{tmp_path}/none")


def test_sinks_versions_and_increments(spark, tmp_path):
    row = [("sh", "600000", dt.date(2024, 1, 2), 2024, 1.0, 1.0, 1.0, 1.0, 1, 1.0)]
    df = spark.createDataFrame(row, increments.RAW)
    files.write_partitioned(df, str(tmp_path / "raw"), "SNAPPY")
    files.write_partitioned(df, str(tmp_path / "raw"), "zstd", append=True)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    with pytest.raises(ValueError):
        files.check_compression("lz5")
    assert versions.open_version(spark, str(tmp_path / "data")) == {}
    doc = versions.commit_version(spark, str(tmp_path / "data"), {"raw_daily": df})
    again = versions.commit_version(spark, str(tmp_path / "data"), {"raw_daily": df.union(df)})
    assert doc["run_id"] != again["run_id"] and versions.open_version(spark, str(tmp_path / "data"))["raw_daily"].count() == 2
    old = spark.createDataFrame(row, increments.RAW)
    assert versions.incremental_plan(None, [], None, [], None) == ("rebuild", "no_previous_version")
    assert versions.incremental_plan(old, old.columns, [5], [7], None)[1] == "factor_window_config_changed"
    assert versions.incremental_plan(old, ["x"], [5], [5], None)[1] == "factor_schema_changed"
    assert versions.incremental_plan(old.limit(0), old.columns, [5], [5], None)[1] == "empty_previous_factors"
    assert versions.incremental_plan(old, old.columns, [5], [5], old)[1] == "historical_adjustment_changed"
    assert versions.incremental_plan(old, old.columns, [5], [5], None) == ("append", "2024-01-02")
    seen = []
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        increments.available_bars(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda b, i: seen.append(increments.latest_only(b).count())).awaitTermination()
    assert seen == [1]


def test_reconcile_and_derive(spark):
    raw = spark.createDataFrame([("sh", "1", dt.date(2024, 1, d), c) for d, c in ((1, 1.0), (2, 10.0), (3, 20.0))], "market string, symbol string, trade_date date, close double")
    exp = spark.createDataFrame([("sh", "1", dt.date(2024, 1, d), c) for d, c in ((1, -0.7), (2, 5.0), (3, 20.0))], "market string, symbol string, trade_date date, adj_close double")
    out = [(r.qfq_factor, r.hfq_factor) for r in reconcile.derive_factors(raw, exp).orderBy("trade_date").collect()]
    assert out == [(0.5, 1.0), (1.0, 2.0)]
    c = reconcile.compare(exp, exp).first()
    assert c.ok and c.max_abs_error == 0.0 and c.mismatches == 0
    assert {r.reason for r in reconcile.excluded(raw, exp.limit(0)).collect()} == {"missing_export_file"}
