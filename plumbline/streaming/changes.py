"""Checks kept up to date as sources change. The batch engine has no streams; this re-runs it for what a stream of files touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "module string, source_text string, source_hash string"


def watch(spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reads Parquet files of changed sources as they arrive in folder and appends check's findings on each batch, with its number, to sink. Batches that are repeated after a failure overwrite their own part, so findings are written once."""

    def batch(df: DataFrame, number: int) -> None:
        check(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
