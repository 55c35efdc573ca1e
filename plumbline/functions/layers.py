"""Layer and stability models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: layer -> layers that it may depend on
BUILT_IN = {"infrastructure": (), "domain": ("infrastructure",), "application": ("domain", "infrastructure"), "presentation": ("application", "domain", "infrastructure")}
STABILITY = {"stable": 0, "normal": 1, "volatile": 2}


def linear(layers: list[str]) -> dict[str, tuple[str, ...]]:
    """Each layer may depend on all that follow it in the list."""
    low = [x.lower() for x in layers]
    return {x: tuple(low[i + 1 :]) for i, x in enumerate(low)}


def explicit(dag: dict[str, list[str]]) -> dict[str, tuple[str, ...]]:
    """As listed; not transitive."""
    return {k.lower(): tuple(x.lower() for x in v) for k, v in dag.items()}


def layer_allowed(source: Column, target: Column, model: dict[str, tuple[str, ...]] = BUILT_IN) -> Column:
    """Same layer, unknown source layer or a listed target; true where either is missing."""
    s, t = F.lower(source), F.lower(target)
    known = s.isin(*model) if model else F.lit(False)
    listed = F.lit(False)
    for layer, below in model.items():
        if below:
            listed = listed | ((s == layer) & t.isin(*below))
    return F.coalesce((s == t) | ~known | listed, F.lit(True))


def rank(stability: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in STABILITY.items():
        out = F.when(F.lower(stability) == name, r).otherwise(out)
    return out


def stability_allowed(source: Column, target: Column) -> Column:
    """A module may depend on what is at least as stable; true where either is missing."""
    return F.coalesce(rank(source) >= rank(target), F.lit(True))


def linear_pairs(layers: DataFrame) -> DataFrame:
    """src and dst of the linear model as rows; layers: pos and layer."""
    a, b = layers.select(F.col("pos").alias("p"), F.lower("layer").alias("src")), layers.select(F.col("pos").alias("q"), F.lower("layer").alias("dst"))
    return a.join(b, F.col("q") > F.col("p")).select("src", "dst")


def model_pairs(spark: SparkSession, model: dict[str, tuple[str, ...]]) -> DataFrame:
    """src and dst of a model as rows."""
    return spark.createDataFrame([(k, x) for k, v in model.items() for x in v], "src string, dst string")
