"""Invariants: where they are stated, how they are verified, what came of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.findings import finding
from plumbline.sources import scan


def collect(module_level: DataFrame, entities: DataFrame) -> DataFrame:
    """module and invariant: those of the module, then `name: requires r` and `name: ensures e` of what is no type. module_level: module, invariant; entities: module, name, kind, requires, ensures (arrays)."""
    e = entities.where(F.coalesce("kind", F.lit("function")) != "type")
    part = lambda field: e.select("module", "name", F.explode(field).alias("x")).select("module", F.concat("name", F.lit(f": {field} "), "x").alias("invariant"))
    return module_level.select("module", "invariant").unionByName(part("requires")).unionByName(part("ensures"))


def checked(invariants: DataFrame, sources: DataFrame) -> DataFrame:
    """The invariants of modules with code, with tier, cache_key and static, the outcome of the static check on code without tests, strings and comments, which is stripped once a module. invariants: module, invariant; sources: module, code."""
    s = sources.where("code is not null").select(F.col("module").alias("m"), "code", scan.strip_to_code(F.col("code")).alias("clean"))
    return invariants.join(s, F.col("module") == F.col("m")).select("module", "invariant", text.classify_invariant(F.col("invariant")).alias("tier"), text.cache_key(F.col("code"), F.col("invariant")).alias("cache_key"), text.static_result(F.col("invariant"), F.col("clean")).alias("static"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of outcomes. rows: tier, static (outcome of a static check or null) and cached (cached verdict or null). An invariant classed static for which there is no check is verified like a behavioral one."""
    static = F.col("static").isNotNull() & (F.col("tier") == "static")
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        n(static & F.col("static"), "static_passed"), n(static & ~F.col("static"), "static_failed"),
        n(~static & F.col("cached"), "verified"), n(~static & ~F.col("cached"), "violated"), n(~static & F.col("cached").isNull(), "unverified"),
        F.count("*").alias("total"),
    )


MODES = {"off": "off", "none": "off", "dry-run": "dry-run", "dry_run": "dry-run", "dryrun": "dry-run", "cached-only": "cached-only", "cached": "cached-only", "full": "full", "on": "full"}


def verify(wanted: DataFrame, cache: DataFrame, mode: str = "cached-only", verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """wanted (with cache_key) and satisfies. off and dry-run look at nothing but the cache's absence; cached-only takes what the cache has; full gives the rest to the verifier, a function of the unverified rows that returns cache_key and satisfies."""
    mode = MODES[mode.lower()]
    if mode in ("off", "dry-run"):
        return wanted.withColumn("satisfies", F.lit(None).cast("boolean"))
    known = wanted.join(cache.select(F.col("cache_key").alias("k"), "satisfies"), F.col("cache_key") == F.col("k"), "left").drop("k")
    if mode == "cached-only" or verifier is None:
        return known
    fresh = verifier(known.where("satisfies is null").drop("satisfies")).select(F.col("cache_key").alias("k"), F.col("satisfies").alias("now"))
    return known.join(fresh, F.col("cache_key") == F.col("k"), "left").withColumn("satisfies", F.coalesce("satisfies", "now")).drop("k", "now")


def bounds_satisfiable(bounds: DataFrame) -> DataFrame:
    """variable and satisfiable: whether a whole number meets all its bounds. bounds: variable, lower, upper (null for none)."""
    b = bounds.groupBy("variable").agg(F.max("lower").alias("low"), F.min("upper").alias("high"))
    return b.select("variable", F.coalesce(F.col("low") <= F.col("high"), F.lit(True)).alias("satisfiable"))


def implied(premises: DataFrame, conclusions: DataFrame) -> DataFrame:
    """variable and valid: whether bounds on whole numbers imply the bounds of the conclusion: all that meet the premises meet it, which holds also where nothing meets them. premises, conclusions: variable, lower, upper (null for none)."""
    tight = lambda df, n: df.groupBy(F.col("variable").alias(f"{n}_v")).agg(F.max("lower").alias(f"{n}_low"), F.min("upper").alias(f"{n}_high"))
    both = tight(conclusions, "c").join(tight(premises, "p"), F.col("c_v") == F.col("p_v"), "left")
    inside = F.coalesce(F.col("p_low") >= F.col("c_low"), F.col("c_low").isNull()) & F.coalesce(F.col("p_high") <= F.col("c_high"), F.col("c_high").isNull())
    return both.select(F.col("c_v").alias("variable"), (inside | F.coalesce(F.col("p_low") > F.col("p_high"), F.lit(False))).alias("valid"))


def description_context(invariants: DataFrame, modules: DataFrame, entities: DataFrame) -> DataFrame:
    """module, invariant and context: the module's description and those of the entities whose name and a colon begin the invariant, a line each, in order of name. invariants: module, invariant; modules: module, description; entities: module, name, description."""
    m = modules.where("description is not null").select(F.col("module").alias("mm"), F.concat(F.lit("Module `"), "module", F.lit("`: "), "description").alias("says"))
    e = entities.where("description is not null").select(F.col("module").alias("em"), F.col("name").alias("en"), F.concat(F.lit("`"), "name", F.lit("`: "), "description").alias("line"))
    near = invariants.distinct().join(e, (F.col("module") == F.col("em")) & F.startswith("invariant", F.concat("en", F.lit(": "))), "left")
    lines = near.groupBy("module", "invariant").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("en").isNotNull(), F.struct("en", "line")))), lambda x: x["line"]).alias("lines"))
    return lines.join(m, F.col("module") == F.col("mm"), "left").select("module", "invariant", F.array_join(F.concat(F.array_compact(F.array("says")), "lines"), "\n").alias("context"))


def outcomes(checked: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of invariants that don't hold: static checks that fail, and of the rest, those with a verdict against them. checked: module, invariant, tier, static, cache_key; known: cache_key, satisfies."""
    rows = checked.join(known.select(F.col("cache_key").alias("k"), "satisfies"), F.col("cache_key") == F.col("k"), "left")
    static = F.col("static").isNotNull() & (F.col("tier") == "static")
    bad = rows.where(F.when(static, ~F.col("static")).otherwise(~F.coalesce("satisfies", F.lit(True))))
    return finding(bad, F.when(static, "static-invariant").otherwise("behavioral-invariant"), F.concat(F.lit("'"), "invariant", F.lit("' does not hold")), subject="invariant", kind="behavioral", tier="behavioral")


CACHE = "cache_key string, satisfies boolean"


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts kept in a folder, by whole key; of several for one key the last written. Empty where there is no folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CACHE)
    kept = spark.read.schema(CACHE + ", at timestamp").parquet(folder)
    return kept.groupBy("cache_key").agg(F.max_by("satisfies", "at").alias("satisfies"))


def write_cache(verdicts: DataFrame, folder: str) -> None:
    """Adds verdicts (cache_key, satisfies); those still unknown are left out."""
    verdicts.where("satisfies is not null").select("cache_key", "satisfies", F.current_timestamp().alias("at")).distinct().write.mode("append").parquet(folder)
