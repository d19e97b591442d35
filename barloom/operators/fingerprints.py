"""Fingerprints of a table's parts, and rebuilds of the parts that a change of history touches.

A fingerprint is a count, an exclusive or and a sum of row hashes: it does not depend on the order of rows, and those of
two sets of rows merge into that of both, so it is one partial aggregation and old fingerprints need not be computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = ("market", "symbol", "trade_year")
FOLDERS = ("trade_year", "market")


def fingerprints(df: DataFrame, keys: tuple[str, ...] = PART) -> DataFrame:
    """(keys, rows, mix, total) of all columns of df, in the order of their names; nulls have a place of their own."""
    h = F.xxhash64(*[x for c in sorted(df.columns) for x in (F.col(c), F.col(c).isNull())])
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("mix"), F.sum(F.shiftright(h, 32)).alias("total"))


def merged(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = PART) -> DataFrame:
    """Fingerprints of the rows of both."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.bit_xor("mix").alias("mix"), F.sum("total").alias("total"))


def changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = PART) -> DataFrame:
    """(keys, kind): parts that were added, removed or changed between two tables of fingerprints."""
    a, b = old.select(*keys, F.struct("rows", "mix", "total").alias("a")), new.select(*keys, F.struct("rows", "mix", "total").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("kind")).where("kind is not null")


def since(changed: DataFrame) -> DataFrame:
    """(market, symbol, since): the first changed year of every instrument that has one; all later rows may depend on it."""
    return changed.groupBy("market", "symbol").agg(F.min("trade_year").alias("since"))


def rebuild(spark: SparkSession, path: str, bars: DataFrame, build: Callable[[DataFrame], DataFrame], touched: DataFrame) -> DataFrame:
    """Brings the table at path (by trade_year and market) up to bars: (trade_year, market) of the folders written anew.

    touched: (market, symbol, since). Only touched instruments are built, from their whole history, and only folders that
    hold rows of theirs from that year on are written; in these the rows of other instruments are carried over. Folders are
    replaced one by one on commit (dynamic partition overwrite); those with nothing left are deleted.
    """
    old = spark.read.parquet(path)
    key = ["market", "symbol"]
    of = lambda df: df.join(touched, key).where(F.col("trade_year") >= F.col("since"))
    folders = of(old.select(*key, "trade_year")).select(*FOLDERS).union(of(bars.select(*key, "trade_year")).select(*FOLDERS)).distinct()
    folders = spark.createDataFrame(folders.collect(), folders.schema)  # at most years times markets
    fresh = of(build(bars.join(touched.select(*key), key, "left_semi"))).select(*old.columns)
    rest = old.join(F.broadcast(folders), list(FOLDERS), "left_semi").join(touched, key, "left").where(F.col("since").isNull() | (F.col("trade_year") < F.col("since"))).select(*old.columns)
    out = rest.unionByName(fresh).repartition(*FOLDERS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)
    left = {tuple(r) for r in bars.select(*FOLDERS).distinct().collect()}  # at most years times markets
    jvm = spark.sparkContext._jvm
    for r in folders.collect():
        if tuple(r) not in left:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/trade_year={r.trade_year}/market={r.market}")
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    return folders
