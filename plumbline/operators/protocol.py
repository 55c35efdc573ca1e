"""Checks of protocol state machines. protocols: module, initial; items: module, field (states or terminal), value; transitions: module, pos, from_state, call, to_state; pairs: module, open_fn, close_fn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.findings import finding, union

#: opening and closing functions whose names tell of a balanced pair
PAIRS = (("open", "close"), ("acquire", "release"), ("lock", "unlock"), ("connect", "disconnect"), ("begin", "end"), ("start", "stop"), ("subscribe", "unsubscribe"), ("register", "unregister"), ("enable", "disable"), ("attach", "detach"))
INIT = ("init", "initialize", "new", "setup")
SHUTDOWN = ("shutdown", "destroy", "dispose", "cleanup", "teardown")


def _states(items: DataFrame) -> DataFrame:
    return items.where("field = 'states'").select(F.col("module").alias("sm"), F.col("value").alias("s")).distinct()


def unknown_states(protocols: DataFrame, items: DataFrame, transitions: DataFrame) -> DataFrame:
    """Initial, terminal and transition states that are not among the states, for protocols that list any; a transition's two states count each."""
    used = protocols.select("module", F.lit("initial").alias("role"), F.col("initial").alias("value")).unionByName(items.where("field = 'terminal'").select("module", F.lit("terminal").alias("role"), "value")).unionByName(transitions.select("module", F.explode(F.array(F.struct(F.lit("from").alias("role"), F.col("from_state").alias("value")), F.struct(F.lit("to").alias("role"), F.col("to_state").alias("value")))).alias("x")).select("module", "x.*"))
    states = _states(items)
    gated = used.join(states.select(F.col("sm").alias("any")).distinct(), F.col("module") == F.col("any"), "left_semi")
    bad = gated.join(states, (F.col("module") == F.col("sm")) & (F.col("value") == F.col("s")), "left_anti")
    return finding(bad, F.concat(F.lit("state-"), F.col("role")), F.concat(F.col("role"), F.lit(" state '"), F.col("value"), F.lit("' is not declared")), subject="value", kind="protocol")


def missing_calls(transitions: DataFrame, pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Transition calls and functions of balanced pairs that the source has neither public nor private. functions: module, name."""
    used = transitions.select("module", F.lit("call").alias("role"), F.col("call").alias("value")).unionByName(pairs.select("module", F.lit("pair").alias("role"), F.explode(F.array("open_fn", "close_fn")).alias("value")))
    f = functions.select(F.col("module").alias("fm"), F.col("name").alias("fn")).distinct()
    bad = used.join(f, (F.col("module") == F.col("fm")) & (F.col("value") == F.col("fn")), "left_anti")
    return finding(bad, F.concat(F.lit("protocol-"), F.col("role")), F.concat(F.lit("function '"), F.col("value"), F.lit("' is not in the source")), subject="value", kind="protocol")


def unreachable(protocols: DataFrame, items: DataFrame, transitions: DataFrame) -> DataFrame:
    """States that are neither initial nor the target of any transition."""
    reached = protocols.select(F.col("module").alias("rm"), F.col("initial").alias("r")).union(transitions.select("module", "to_state")).distinct()
    return finding(_states(items).join(reached, (F.col("sm") == F.col("rm")) & (F.col("s") == F.col("r")), "left_anti"), "unreachable", F.concat(F.lit("nothing leads to '"), F.col("s"), F.lit("'")), module="sm", subject="s", kind="protocol", severity="warning")


def dead_ends(items: DataFrame, transitions: DataFrame) -> DataFrame:
    """States that are not terminal and that no transition leaves."""
    out = items.where("field = 'terminal'").select(F.col("module").alias("om"), F.col("value").alias("o")).union(transitions.select("module", "from_state")).distinct()
    return finding(_states(items).join(out, (F.col("sm") == F.col("om")) & (F.col("s") == F.col("o")), "left_anti"), "dead-end", F.concat(F.lit("nothing leaves '"), F.col("s"), F.lit("'")), module="sm", subject="s", kind="protocol", severity="warning")


def balanced_pairs(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Balanced pairs whose functions are called unequally often. sources: module, code; pairs: module, open_fn, close_fn."""
    p = pairs.select(F.col("module").alias("pm"), "open_fn", "close_fn")
    n = sources.join(p, F.col("module") == F.col("pm")).withColumn("o", text.count_calls(F.col("code"), F.col("open_fn"))).withColumn("c", text.count_calls(F.col("code"), F.col("close_fn"))).where("o <> c")
    check = F.when(F.col("c") == 0, "never-closed").when(F.col("o") == 0, "never-opened").otherwise("unbalanced")
    return finding(n, check, F.concat(F.col("open_fn"), F.lit(" "), F.col("o").cast("string"), F.lit(", "), F.col("close_fn"), F.lit(" "), F.col("c").cast("string")), subject="open_fn", kind="protocol", severity="warning")


def detect_pairs(functions: DataFrame) -> DataFrame:
    """module, open_fn and close_fn of the balanced pairs that names tell of, exact or behind a common prefix with an underscore. functions: module, name."""
    f = functions.select("module", "name").distinct()
    cases = [F.when((F.col("name") == o) | F.col("name").endswith("_" + o), F.concat(F.substring(F.col("name"), F.lit(1), F.length("name") - len(o)), F.lit(c))) for o, c in PAIRS]
    want = f.select("module", F.col("name").alias("open_fn"), F.explode(F.array_compact(F.array(*cases))).alias("close_fn"))
    return want.join(f.select(F.col("module").alias("m"), F.col("name").alias("n")), (F.col("module") == F.col("m")) & (F.col("close_fn") == F.col("n")), "left_semi")


def lifecycle(functions: DataFrame) -> DataFrame:
    """module, states, terminal and transitions that names tell of: from `initial` by the first well-known opening function to `ready`, and from there, or from `initial`, by the first closing one to `terminated`. Of modules with neither balanced pairs nor an opening function there is no row. functions: module, name."""
    pick = lambda names: F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(F.col("all"), n)), F.lit(1))
    paired = detect_pairs(functions).select(F.col("module").alias("pm"), F.lit(True).alias("paired")).distinct()
    named = functions.groupBy("module").agg(F.collect_set("name").alias("all")).select("module", pick(INIT).alias("up"), pick(SHUTDOWN).alias("down"))
    f = named.join(paired, F.col("module") == F.col("pm"), "left").where("paired or up is not null")
    step = lambda a, call, b: F.struct(a.alias("from_state"), F.col(call).alias("call"), F.lit(b).alias("to_state"))
    rest = F.when(F.col("up").isNotNull(), "ready").otherwise("initial")
    some = lambda c, x: F.when(F.col(c).isNotNull(), x)
    return f.select(
        "module", F.array_compact(F.array(F.lit("initial"), some("up", "ready"), some("down", "terminated"))).alias("states"), F.array_compact(F.array(some("down", "terminated"))).alias("terminal"),
        F.array_compact(F.array(some("up", step(F.lit("initial"), "up", "ready")), some("down", step(rest, "down", "terminated")))).alias("transitions"),
    )


def all_checks(protocols: DataFrame, items: DataFrame, transitions: DataFrame, pairs: DataFrame, functions: DataFrame) -> DataFrame:
    return union(unknown_states(protocols, items, transitions), missing_calls(transitions, pairs, functions), unreachable(protocols, items, transitions), dead_ends(items, transitions))
