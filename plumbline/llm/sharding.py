"""Operator 2, contiguous shards of equal bytes.

Rows are put in order of doc_id by a range partitioning of (doc_id, bytes) alone,
written once so that all that follows sees the same partitions. The totals of the
partitions, one row each, give every partition its offset; a running sum inside the
partition completes the global prefix sum. A row goes to the shard in whose equal
share of all bytes its first byte falls, so shards are contiguous in doc_id and none exceeds its
share by more than one row.

Defined cases: a null or empty text has 0 bytes. A null doc_id comes first. Rows with the
same doc_id are ordered by size, then alike. If all rows are empty they are in shard 0; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster

SHARDS = 64


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, bytes and shard (0 to n_shards - 1), a row for each row of docs."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"))
    ranged = cluster.written(sized.repartitionByRange("doc_id").select("doc_id", "bytes", F.spark_partition_id().alias("part")))
    # one row for each partition: its size follows the number of partitions, not the data
    totals = ranged.groupBy("part").agg(F.sum("bytes").alias("size"))
    order = Window.orderBy("part")
    offsets = totals.select("part", (F.sum("size").over(order) - F.col("size")).alias("before"), F.sum("size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "bytes").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("upto", F.sum("bytes").over(inside))
    start = f"cast(before + upto - bytes as decimal(38, 0)) * {int(n_shards)}"
    return run.join(offsets, "part").select("doc_id", "bytes", F.expr(f"cast(if(total = 0, 0, least({int(n_shards) - 1}, ({start}) div total)) as int)").alias("shard"))
