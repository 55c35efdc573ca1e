"""The findings table, in which every check reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("module", "subject", "kind", "tier", "severity", "check_id", "message")


def finding(df: DataFrame, check_id: str | Column, message: Column, *, module: Column | str = "module", subject: Column | str = "subject", kind: str = "structural", tier: str = "syntactic", severity: str | Column = "error") -> DataFrame:
    """Rows of df as findings."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(of(module).alias("module"), of(subject).alias("subject"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), col(severity).alias("severity"), col(check_id).alias("check_id"), message.alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def totals(modules: DataFrame, findings: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """passed, errors and warnings. A module passes that has no finding; findings of compositions (extra) add only to errors and warnings."""
    per = findings.groupBy(F.col("module").alias("m")).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    counted = modules.select("module").join(per, F.col("module") == F.col("m"), "left")
    out = counted.agg(F.count_if(F.col("m").isNull()).alias("passed"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))
    if extra is None:
        return out
    more = extra.agg(F.count_if(F.col("severity") == "error").alias("xe"), F.count_if(F.col("severity") == "warning").alias("xw"))
    return out.crossJoin(more).select("passed", (F.col("errors") + F.col("xe")).alias("errors"), (F.col("warnings") + F.col("xw")).alias("warnings"))


def verdict(summary: DataFrame) -> DataFrame:
    """The totals with verdict and exit code."""
    word = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed with warnings").otherwise("passed")
    return summary.withColumn("verdict", word).withColumn("exit_code", F.when(F.col("errors") > 0, 1).otherwise(0))
