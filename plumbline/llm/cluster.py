"""What the operators of this package share on the cluster: cutting lineage, bounded iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import kernel


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from spark.checkpoint.dir. Only where that is unset and all runs in one process, as in tests, a local one; on a cluster an error is raised."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="plumbline-")


def _hadoop_path(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/plumbline-{kind}-{uuid.uuid4().hex}"
    there, system = _hadoop_path(spark, path)
    system.mkdirs(there)
    system.deleteOnExit(there)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    there, system = _hadoop_path(spark, path)
    system.delete(there, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, 'table')}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds of what a task holds of a table of texts at once. With Spark's own (10,000 rows to Python, column vectors of 4,096 rows) long texts take much of an executor's memory.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def bounded_batches(spark: SparkSession) -> None:
    """Texts are read 512 rows at a time and go to the Python workers in batches of 4 MB or 2000 rows, or one row, for this session, unless it has bounds of its own. No result depends on it."""
    for key, value in BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


#: Bytes a core below which a table in fewer files than there are cores is dealt out anew.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a small table in so few files that most cores would have none of it, else as it is. No result depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def arrow_column(run: Callable[[pa.Array], pa.Array], ddl: str):
    """Column function of one Arrow array. After each batch the worker gives memory back, since workers outlive their tasks."""

    def column(x: pa.Array) -> pa.Array:
        out = run(x)
        kernel.release()
        return out

    column.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(column, ddl)


#: Rows up to which a narrow table of chosen ids is broadcast.
FEW_ROWS = 200_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df, written, with the hint to broadcast it if it has no more rows than `most`; a larger one is left to a shuffled join."""
    df = written(df)
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node of its component, for the ends of the edges (a, b); roots are left out.

    Large-star and small-star in turn (Kiveris et al., 2014) until nothing changes;
    the number of rounds grows with the logarithm of a component's size.
    """
    spark = edges.sparkSession
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(least, F.col("a") == F.col("c"))
        pairs = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("p"))
        e = written(pairs.select("p.a", "p.b").where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
