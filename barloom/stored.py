"""Derived tables that are written once a session and input, bucketed and sorted by instrument.

Windows over a series and joins on the bar's key then need neither an exchange nor a sort: all bars of an instrument lie
in one bucket, in the order of their days. Only narrow tables are stored: what is computed from a bar and those before it
costs less to compute again than to write, as a query then computes the columns alone that it reads. A table is named after what it was built from (paths, sizes and times of the input's files), so
a changed input is built anew. Tables lie in the folder that the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What every bucketed table is dealt and sorted by.
BUCKET = ("market", "symbol")
SORT = ("market", "symbol", "trade_date")
#: Bytes of the input's files for each bucket, so that a task sorts its bucket in memory however large the input is.
BUCKET_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def input_files(spark: SparkSession, path: str) -> list:
    """File statuses of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [fs.getFileStatus(p)] if fs.getFileStatus(p).isFile() else list(fs.listStatus(p))


def input_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files."""
    seen = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in input_files(spark, path))
    return hashlib.md5("\n".join(seen).encode()).hexdigest()[:16]


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets of what is derived from a table: the session's partitions, more for a large input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(f.getLen() for f in input_files(spark, path)) // BUCKET_BYTES))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """df as table `name` at path, one sorted file a bucket; df is dealt out once, as the buckets are."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The writer sorts a bucket itself. Where df lies in such buckets already, nothing is dealt out again.
    df.repartition(n, *BUCKET).write.mode("error").format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *BUCKET).sortBy(*SORT).saveAsTable(name)
    # Buckets by instrument serve joins on instrument and day too, and their one sorted file each needs no sort.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(name)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table `name` of the input at source: built and written when first asked for."""
    app = re.sub(r"\W", "_", spark.sparkContext.applicationId)
    full = f"barloom_{name}_{input_state(spark, source)}_{app}"
    if not spark.catalog.tableExists(full):
        write_bucketed(build(), full, f"{shared_dir(spark)}/{full}-{uuid.uuid4().hex}", bucket_count(spark, source))
    return spark.table(full)


PLANNED: dict[tuple[str, str, int], DataFrame] = {}


def planned(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table `name` of the input at source as a plan that is made once a session: nothing is written."""
    key = (name, input_state(spark, source) + spark.sparkContext.applicationId, id(spark))
    if key not in PLANNED:
        PLANNED[key] = build()
    return PLANNED[key]


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, for results that several others are made of."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
