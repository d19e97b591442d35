"""New raw bars as a stream of files, taken as they are there and then done: batches for the incremental factor build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

RAW = "market string, symbol string, trade_date date, trade_year int, open double, high double, low double, close double, volume long, amount double"


def available_bars(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls each(batch, number) for the Parquet files that came since the last run; a file is taken once per checkpoint."""
    return spark.readStream.schema(RAW).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_only(batch: DataFrame) -> DataFrame:
    """One row for each bar of a batch in which files repeat some."""
    return batch.dropDuplicates(["market", "symbol", "trade_date"])
