"""Versioned datasets: a version is a folder of Parquet tables, a small manifest names the current one.

All paths go through Spark's file systems. The manifest is written last, so readers see a whole version or the old one.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import check_compression


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")


def commit_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], run_id: str | None = None, compression: str = "zstd") -> dict:
    """Writes tables as a new version, then points the manifest at it; a failed write leaves the manifest alone."""
    run_id = run_id or new_run_id()
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/versions/{run_id}/parquet/{name}"
        w = df.write.mode("error").option("compression", check_compression(compression))
        (w.partitionBy("trade_year", "market") if {"trade_year", "market"} <= set(df.columns) else w).parquet(paths[name])
    doc = {"run_id": run_id, "generated_at": datetime.now(timezone.utc).isoformat(), "tables": paths}
    fs, part = _fs(spark, f"{root}/latest.json.{run_id}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(doc).encode()))
    out.close()
    # One rename that replaces: readers find the old manifest or the new one.
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf)
    files.rename(fs.makeQualified(part), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/latest.json")), options)
    return doc


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    fs, p = _fs(spark, f"{root}/latest.json")
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(f"{root}/latest.json", wholetext=True).first()[0])


def open_version(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    doc = read_manifest(spark, root)
    return {n: spark.read.parquet(p) for n, p in doc["tables"].items()} if doc else {}


def incremental_plan(old: DataFrame | None, new_columns: list[str], old_windows: list[int] | None, windows: list[int], changed: DataFrame | None) -> tuple[str, str | None]:
    """("append", last day) or ("rebuild", reason)."""
    if old is None:
        return "rebuild", "no_previous_version"
    if old_windows is not None and sorted(old_windows) != sorted(windows):
        return "rebuild", "factor_window_config_changed"
    if set(old.columns) != set(new_columns):
        return "rebuild", "factor_schema_changed"
    last = old.agg(F.max("trade_date").alias("d")).first()["d"]
    if last is None:
        return "rebuild", "empty_previous_factors"
    if changed is not None and not changed.isEmpty():
        return "rebuild", "historical_adjustment_changed"
    return "append", str(last)


def append_rows(factors: DataFrame, last_day: str) -> DataFrame:
    """Rows after last_day of factors computed from the whole history: equal to what a full build holds."""
    return factors.where(F.col("trade_date") > F.lit(last_day).cast("date"))
