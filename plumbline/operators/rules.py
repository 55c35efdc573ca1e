"""The rule language: conditions on the source and target of a dependency, compiled to columns.

    or      a OR b,  a or b,  a || b
    and     a AND b, a and b, a && b
    not     NOT a, not a, !a
    compare x == y, x != y
    test    source.layer.can_depend_on(target.layer), source.stability.can_depend_on(target.stability), source.context.exists
    value   'text', "text", source.P, target.P, a bare word

Parentheses group. With parity=True they do not: an operand in parentheses is then a non-empty text, hence true,
and quoted operators split, as in the tool whose rule files these are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import layers
from plumbline.operators.findings import finding, union

#: property -> column of the modules table
PROPERTIES = {"module": "module", "name": "module", "language": "language", "source_path": "source_path", "path": "source_path", "layer": "layer", "context": "context", "stability": "stability"}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    name: str
    require: str
    when: str = "true"
    description: str | None = None
    severity: str = "error"


BUILT_IN = (
    Rule("layer-direction", "source.layer.can_depend_on(target.layer)", "source.layer.exists AND target.layer.exists", "a layer may only use the layers beneath it"),
    Rule("context-isolation", "source.layer == presentation OR target.layer == presentation", "source.context.exists AND target.context.exists AND source.context != target.context", "another context is reached through presentation only"),
    Rule("stability-direction", "source.stability.can_depend_on(target.stability)", "source.stability.exists AND target.stability.exists", "what a module uses must be as stable as itself"),
)


def configured(disabled: list[str] = (), custom: list[Rule] = (), base: tuple[Rule, ...] = BUILT_IN) -> list[Rule]:
    """The built-in rules less those disabled, then the custom ones."""
    return [r for r in base if r.name not in disabled] + list(custom)


def _split(text: str, operators: tuple[str, ...], parity: bool) -> tuple[str, str] | None:
    """Both sides of the leftmost operator outside parentheses and, unless parity, quotes."""
    depth, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote and not parity:
            quote = "" if c == quote else quote
        elif c in "'\"" and not parity:
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0:
            for op in operators:
                if text.startswith(op, i):
                    return text[:i], text[i + len(op) :]
        i += 1
    return None


def _grouped(text: str) -> bool:
    """Whether one pair of parentheses encloses the whole text."""
    if not (text.startswith("(") and text.endswith(")")):
        return False
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


class Compiler:
    """Compiles conditions to boolean columns of an edge table with columns s_<property> and t_<property>."""

    def __init__(self, model: dict[str, tuple[str, ...]] = layers.BUILT_IN, parity: bool = False):
        self.model, self.parity = model, parity

    def condition(self, text: str) -> Column:
        t = text.strip()
        if t in ("true", "false"):
            return F.lit(t == "true")
        if not self.parity and _grouped(t):
            return self.condition(t[1:-1])
        for operators, join in (((" OR ", " or ", "||"), Column.__or__), ((" AND ", " and ", "&&"), Column.__and__)):
            for op in operators if self.parity else (operators,):
                if two := _split(t, (op,) if self.parity else op, self.parity):
                    return join(self.condition(two[0]), self.condition(two[1]))
        for mark in ("NOT ", "not ", "!"):
            if t.startswith(mark):
                return ~self.condition(t[len(mark) :])
        for op, same in (("==", True), ("!=", False)):
            if two := _split(t, (op,), self.parity):
                equal = self.value(two[0]) == self.value(two[1])
                return equal if same else ~equal
        if ".can_depend_on(" in t:
            return self._can_depend(t)
        if t.endswith(".exists"):
            return self.value(t[: -len(".exists")]) != ""
        v = self.value(t)
        return (v != "") & ~v.isin("none", "null")

    def value(self, text: str) -> Column:
        t = text.strip()
        if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
            return F.lit(t[1:-1])
        bare = t.lower().removeprefix("stability::")
        if bare in layers.STABILITY:
            return F.lit(bare)
        if m := re.fullmatch(r"(source|target)\.(.+)", t):
            if m[2] not in PROPERTIES:
                raise RuleError(f"no property {m[2]!r}")
            c = F.coalesce(F.col(f"{m[1][0]}_{PROPERTIES[m[2]]}"), F.lit(""))
            return F.lower(c) if PROPERTIES[m[2]] in ("layer", "stability") else c
        return F.lit(t)

    def _can_depend(self, t: str) -> Column:
        if "layer.can_depend_on" in t:
            return layers.layer_allowed(F.col("s_layer"), F.col("t_layer"), self.model)
        if "stability.can_depend_on" in t:
            return layers.stability_allowed(F.col("s_stability"), F.col("t_stability"))
        raise RuleError(f"can_depend_on is for layers and stability: {t!r}")


def sided(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges src, dst with the properties of both modules; edges whose ends are not in modules are left out."""
    columns = list(dict.fromkeys(PROPERTIES.values()))
    side = lambda p: modules.select(*(F.col(c).alias(f"{p}_{c}") for c in columns))
    return edges.join(side("s"), F.col("src") == F.col("s_module")).join(side("t"), F.col("dst") == F.col("t_module"))


def violations(pairs: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILT_IN, model: dict[str, tuple[str, ...]] = layers.BUILT_IN, parity: bool = False) -> DataFrame:
    """src, dst, rule, severity and message of every edge and rule that applies and isn't met; one pass over the edges. A rule that does not compile is violated by every edge, as an error."""
    compiler, cases = Compiler(model, parity), []
    for r in rules:
        try:
            bad, severity, says = compiler.condition(r.when) & ~compiler.condition(r.require), r.severity, r.description or r.require
        except RuleError as e:
            bad, severity, says = F.lit(True), "error", f"cannot be evaluated: {e}"
        message = F.concat(F.lit("'"), F.col("src"), F.lit("' -> '"), F.col("dst"), F.lit(f"': {says}"))
        cases.append(F.when(bad, F.struct(F.lit(r.name).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))))
    if not cases:
        cases = [F.lit(None).cast("struct<rule:string,severity:string,message:string>")]
    return pairs.select("src", "dst", F.explode(F.array_compact(F.array(*cases))).alias("v")).select("src", "dst", "v.rule", "v.severity", "v.message")


def rule_findings(v: DataFrame) -> DataFrame:
    return finding(v, F.concat(F.lit("rule:"), F.col("rule")), F.col("message"), module="src", subject="dst", kind="architectural", tier="rules-engine", severity=F.col("severity"))


__all__ = ["BUILT_IN", "Compiler", "Rule", "RuleError", "configured", "rule_findings", "sided", "union", "violations"]
