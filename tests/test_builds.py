import datetime as dt
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom import stored
from barloom.operators import fingerprints as fp
from barloom.operators import reports
from barloom.plans import build_queries as bq
from barloom.plans.factor_queries import all_factors
from barloom.sources.bars import raw_daily

ROWS = "market string, symbol string, trade_date date, trade_year int, close double"


def rows(spark, some):
    return spark.createDataFrame([(m, s, dt.date(y, 1, d), y, c) for m, s, y, d, c in some], ROWS)


def test_fingerprints_do_not_depend_on_order_and_merge(spark):
    some = [("sh", "1", 2020 + i % 2, 1 + i, None if i == 3 else float(i)) for i in range(20)]
    a = {tuple(r) for r in fp.fingerprints(rows(spark, some)).collect()}
    shuffled = random.Random(2).sample(some, 20)
    assert a == {tuple(r) for r in fp.fingerprints(rows(spark, shuffled).repartition(5)).collect()}
    parts = fp.merged(fp.fingerprints(rows(spark, shuffled[:7])), fp.fingerprints(rows(spark, shuffled[7:])))
    assert a == {tuple(r) for r in parts.collect()}
    twice = {tuple(r) for r in fp.fingerprints(rows(spark, some + some)).collect()}
    assert not a & twice


def test_changes(spark):
    old = [("sh", "1", 2020, 1, 1.0), ("sh", "1", 2021, 1, 1.0), ("sh", "2", 2020, 1, 1.0), ("sz", "1", 2022, 1, None), ("sh", "4", 2020, 1, 1.0), ("sh", "4", 2020, 2, 2.0)]
    new = [("sh", "1", 2020, 1, 1.0), ("sh", "1", 2021, 1, 1.5), ("sz", "1", 2022, 1, 0.0), ("sz", "9", 2019, 1, 1.0), ("sh", "4", 2020, 2, 1.0), ("sh", "4", 2020, 1, 2.0)]
    got = fp.changes(fp.fingerprints(rows(spark, old)), fp.fingerprints(rows(spark, new)))
    assert {(r.market, r.symbol, r.trade_year, r.kind) for r in got.collect()} == {("sh", "1", 2021, "changed"), ("sh", "2", 2020, "removed"), ("sz", "1", 2022, "changed"), ("sz", "9", 2019, "added"), ("sh", "4", 2020, "changed")}
    assert {(r.market, r.symbol, r.since) for r in fp.since(got).collect()} >= {("sh", "1", 2021), ("sz", "9", 2019)}


def test_rebuild_equals_full_build_and_leaves_other_folders(spark, sf_dir, tmp_path):
    raw = raw_daily(spark, sf_dir)
    new = bq.edited(raw).where("not (market = 'sh' and trade_year = 1995)")  # a folder that ends up empty
    path = str(tmp_path / "f")
    bq.build(raw).repartition(*fp.FOLDERS).write.partitionBy(*fp.FOLDERS).parquet(path)
    before = {f.name: f for f in (tmp_path / "f").rglob("*.parquet")}
    touched = fp.since(fp.changes(fp.fingerprints(raw), fp.fingerprints(new))).where("not (market = 'bj' and symbol = 'none')")
    folders = {(r.trade_year, r.market) for r in fp.rebuild(spark, path, new, bq.build, touched).collect()}
    got, want = spark.read.parquet(path), bq.build(new)
    order = sorted(want.columns)
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])
    assert got.count() == want.count() and rounded(got).exceptAll(rounded(want)).isEmpty() and order == sorted(got.columns)
    assert not (tmp_path / "f" / "trade_year=1995" / "market=sh").exists() and (1995, "sh") in folders
    after = {f.name for f in (tmp_path / "f").rglob("*.parquet")}
    kept = [n for n, f in before.items() if (int(f.parent.parent.name[-4:]), f.parent.name[7:]) not in folders]
    assert set(kept) <= after


def test_nothing_changed_writes_nothing(spark, sf_dir, tmp_path):
    raw = raw_daily(spark, sf_dir)
    path = str(tmp_path / "f")
    bq.build(raw).write.partitionBy(*fp.FOLDERS).parquet(path)
    names = {f.name for f in (tmp_path / "f").rglob("*.parquet")}
    same = fp.since(fp.changes(fp.fingerprints(raw), fp.fingerprints(raw)))
    assert fp.rebuild(spark, path, raw, bq.build, same).count() == 0
    assert {f.name for f in (tmp_path / "f").rglob("*.parquet")} == names


def test_report_of_a_write(spark, tmp_path):
    df = rows(spark, [("sh", "1", 2020, d, None if d % 3 else float(d)) for d in range(1, 10)] + [("sz", "1", 2021, 1, 1.0)])
    path = str(tmp_path / "t")
    got = {r.group: r for r in reports.write_reported(df, path, {"price": ["close"], "key": ["symbol", "trade_date"]}).collect()}
    assert (got["price"].rows, got["price"].nulls, got["price"].columns) == (10, 6, 1) and (got["key"].nulls, got["key"].columns) == (0, 2)
    assert got["price"].bytes > 0 and got["key"].bytes > 0
    s = reports.stored_summary(spark, path).first()
    assert (s.files, s.rows) == (2, 10) and s.bytes >= got["price"].bytes + got["key"].bytes
    with pytest.raises(ValueError):
        reports.write_reported(df, path, {"x": ["nope"]})


def test_a_report_without_exchange_counts_the_same(spark, tmp_path):
    df = rows(spark, [("sh", "1", 2020, d, None if d % 3 else float(d)) for d in range(1, 10)] + [("sz", "1", 2021, 1, 1.0)])
    groups = {"price": ["close"], "key": ["symbol", "trade_date"]}
    stage = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("reported")
    spark.sparkContext.setJobGroup("reported", "")
    got = reports.write_reported(df, str(tmp_path / "a"), groups, exchange=False)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    first = spark.sparkContext.statusTracker().getJobInfo(min(stage()))
    assert len(first.stageIds) == 1  # written where the rows lie
    want = reports.write_reported(df, str(tmp_path / "b"), groups)
    kept = ["group", "columns", "rows", "nulls"]
    assert got.select(kept).exceptAll(want.select(kept)).isEmpty() and got.where("bytes > 0").count() == 2
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_the_indicator_table_is_written_whole_and_packed_without_adjusted_bars(spark, sf_dir, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    (source / "lineitem.parquet").write_bytes((Path(sf_dir) / "lineitem.parquet").read_bytes())
    paths = []
    write = reports.write_reported
    monkeypatch.setattr(reports, "write_reported", lambda df, path, *a, **k: paths.append(path) or write(df, path, *a, **k))
    report = bq.build_report(spark, str(source)).collect()
    state = stored.input_state(spark, f"{source}/lineitem.parquet")
    assert {t.name.split(f"_{state}")[0] for t in spark.catalog.listTables() if state in t.name} == {"barloom_raw_daily"}
    got, want = spark.read.parquet(paths[0]), all_factors(spark, sf_dir).select(*bq.TABLE)
    assert sorted(got.columns) == sorted(want.columns) and len(got.columns) == 73
    same = got.select(*want.columns)  # every value as it was computed
    assert same.exceptAll(want).isEmpty() and want.exceptAll(same).isEmpty()
    assert {r.rows for r in report} == {want.count()} and all(r.bytes > 0 for r in report)
    files = [f.removeprefix("file:") for f in reports.parquet_files(spark, paths[0])]
    chunks = [g.column(c) for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups)) for c in range(m.num_columns)]
    assert not any("DICTIONARY" in e for x in chunks for e in x.encodings)
