"""The type-formula language: `has_field(Self, items) and not cloneable`.

    formula    f or f, f and f, not f, (f), implies(f, f), predicate
    predicate  equals, matches, is_subtype, is_sum, is_product, is_function, has_field, has_method, has_variant,
               cloneable, serializable, send, sync, fallible, no_unsafe; those of one type may leave it out (Self)
    type       Self, field(n), param(i or name), return, con(T), arg(T, n), apply(F, A..), function(A.., R),
               domain(F, n), codomain(F), sum(..), product(..), a type literal, a name

A result is true, false or an error; errors are values and pass through unless a connective is decided without them.
Each distinct formula is parsed once in a Python worker; evaluation is an Arrow function over entity rows, and is
done once for entities that differ in nothing but module and name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import batches as arrow
from plumbline.operators import types
from plumbline.operators.findings import finding
from plumbline.operators.types import INFER, Type

#: predicate -> number of arguments
PREDICATES = {"equals": 2, "matches": 2, "is_subtype": 2, "is_sum": 1, "is_product": 1, "is_function": 1, "has_field": 2, "has_method": 2, "has_variant": 2, "cloneable": 1, "serializable": 1, "send": 1, "sync": 1, "fallible": 1, "no_unsafe": 1}
TRAITS = {"cloneable": ("Clone",), "serializable": ("Serialize",), "send": ("Send",), "sync": ("Sync",)}
TYPE_FORMS = {"field", "param", "con", "arg", "apply", "function", "domain", "codomain", "sum", "product"}


class FormulaError(ValueError):
    pass


# parsing


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text): name, int, str, type, or the sign itself."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "(),":
            out.append((c, c))
            i += 1
        elif c in "'\"":
            j = text.find(c, i + 1)
            if j < 0:
                raise FormulaError("a string is not closed")
            out.append(("str", text[i + 1 : j]))
            i = j + 1
        elif c.isdigit():
            m = re.match(r"\d+", text[i:])
            out.append(("int", m[0]))
            i += m.end()
        elif c in "&[?":
            j = i
            while j < len(text) and text[j] in "&?":
                j += 1
            if m := re.match(r"mut\s+", text[j:]):
                j += m.end()
            if j < len(text) and text[j] == "[":
                j = types._closing(text, j) + 1
            elif m := re.match(r"\w+", text[j:]):
                j += m.end()
                if text[j : j + 1] == "<":
                    j = types._closing(text, j) + 1
            out.append(("type", text[i:j]))
            i = j
        elif c.isalpha() or c == "_":
            m = re.match(r"\w+", text[i:])
            j = i + m.end()
            if m[0] == "fn" and text[j:].lstrip().startswith("("):
                j = types._closing(text, text.index("(", j)) + 1
                if a := re.match(r"\s*->\s*", text[j:]):
                    j += a.end()
                    depth = 0
                    while j < len(text) and not (depth == 0 and text[j] in ",)"):
                        depth += (text[j] in types.OPEN) - (text[j] in types.CLOSE and text[j - 1] not in "-=")
                        j += 1
                out.append(("type", text[i:j].strip()))
            elif text[j : j + 1] == "<":
                j = types._closing(text, j) + 1
                out.append(("type", text[i:j]))
            else:
                out.append(("name", m[0]))
            i = j
        else:
            raise FormulaError(f"unexpected {c!r}")
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None) -> str:
        have = self.peek()
        if have[0] == "end" or kind and have[0] != kind:
            raise FormulaError(f"expected {kind or 'more'}, found {have[1] or 'the end'!r}")
        self.at += 1
        return have[1]

    def formula(self) -> tuple:
        out = self.any_of()
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r}")
        return out

    def any_of(self) -> tuple:
        left = self.all_of()
        while self.peek() == ("name", "or"):
            self.at += 1
            left = ("or", left, self.all_of())
        return left

    def all_of(self) -> tuple:
        left = self.negated()
        while self.peek() == ("name", "and"):
            self.at += 1
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.peek() == ("name", "not"):
            self.at += 1
            return ("not", self.negated())
        if self.peek()[0] == "(":
            self.at += 1
            inner = self.any_of()
            self.take(")")
            return inner
        name = self.take("name")
        if name == "implies":
            self.take("(")
            a = self.any_of()
            self.take(",")
            b = self.any_of()
            self.take(")")
            return ("implies", a, b)
        if name not in PREDICATES:
            raise FormulaError(f"no predicate {name!r}")
        args: list[Any] = []
        if self.peek()[0] == "(":
            self.at += 1
            while self.peek()[0] != ")":
                if args:
                    self.take(",")
                args.append(self.word() if name.startswith("has_") and len(args) == 1 or name == "matches" and len(args) == 1 else self.type())
            self.take(")")
        if len(args) == PREDICATES[name] - 1:
            args.insert(0, ("Self",))
        if len(args) != PREDICATES[name]:
            raise FormulaError(f"{name} takes {PREDICATES[name]}")
        return ("is", name, *args)

    def word(self) -> str:
        if self.peek()[0] not in ("name", "str", "type", "int"):
            raise FormulaError("expected a name")
        return self.take()

    def type(self) -> tuple:
        kind, text = self.peek()
        if kind == "(" and self.peek(1)[0] == ")":
            self.at += 2
            return ("literal", types.UNIT)
        if kind in ("type", "str"):
            self.at += 1
            return ("literal", types.parse(text))
        name = self.take("name")
        if name in ("Self", "return"):
            return (name,)
        if name in TYPE_FORMS and self.peek()[0] == "(":
            self.at += 1
            args: list[Any] = []
            while self.peek()[0] != ")":
                if args:
                    self.take(",")
                first = not args
                if self.peek()[0] == "int":
                    args.append(int(self.take()))
                elif name in ("field", "param") and first:
                    args.append(self.word())
                else:
                    args.append(self.type())
            self.take(")")
            return (name, *args)
        return ("literal", types.parse(name))


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple | str:
    """The formula's tree, or what is wrong with it."""
    try:
        return Parser(text).formula()
    except FormulaError as e:
        return str(e)


# evaluation


class Context:
    """An entity with what is known of it: name, kind, type_info and function_info as dicts or None."""

    def __init__(self, name: str, type_info: dict | None, function_info: dict | None, in_function: bool):
        self.name, self.type, self.function, self.in_function = name, type_info, function_info, in_function
        #: whether an outcome depends on how a stand-in for the name is spelled
        self.spelled = False

    def resolve(self, x: tuple) -> Type:
        form, *a = x
        match form:
            case "Self":
                return Type("named", "Self" if self.in_function else self.name)
            case "literal":
                return a[0]
            case "field":
                for f in (self.type or {}).get("fields") or []:
                    if f["name"] == str(a[0]):
                        return types.parse(f["type"])
                raise FormulaError(f"no field {a[0]!r}")
            case "param":
                params = (self.function or {}).get("params") or []
                for i, p in enumerate(params):
                    if i == a[0] or p["name"] == a[0]:
                        return types.parse(p["type"])
                raise FormulaError(f"no parameter {a[0]!r}")
            case "return":
                r = (self.function or {}).get("return_type")
                if r is None:
                    raise FormulaError("no return type")
                return types.parse(r)
            case "con":
                t = self.resolve(a[0])
                return Type("named", t.name) if t.form == "named" else t
            case "arg":
                t = self.resolve(a[0])
                n = a[1] if len(a) > 1 else 0
                if t.form != "named" or n >= len(t.args):
                    raise FormulaError(f"no argument {n} of {t}")
                return t.args[n]
            case "apply":
                return Type("named", types.base_name(self.resolve(a[0])), tuple(map(self.resolve, a[1:])))
            case "function":
                return Type("fn", "", tuple(map(self.resolve, a)))
            case "domain" | "codomain":
                t = self.resolve(a[0])
                if t.form != "fn":
                    raise FormulaError(f"{t} is no function")
                n = len(t.args) - 1 if form == "codomain" else a[1] if len(a) > 1 else 0
                if form == "domain" and n >= len(t.args) - 1:
                    raise FormulaError(f"no parameter {n} of {t}")
                return t.args[n]
        return Type("tuple", "", tuple(map(self.resolve, a)))

    def known(self, t: Type) -> dict | None:
        """The definition at hand, if t names it."""
        return self.type if self.type is not None and types.base_name(t) in (self.name, "Self") else None

    def holds(self, name: str, a: tuple) -> bool:
        if name == "no_unsafe":
            return True  # nothing here can see into bodies
        t = self.resolve(a[0])
        match name:
            case "equals" | "is_subtype":
                x, y = types.bare(t), types.bare(self.resolve(a[1]))
                return INFER in (x, y) or x == y
            case "matches":
                self.spelled |= STAND_IN in (text := str(t))
                return re.fullmatch(".*".join(map(re.escape, a[1].split("_"))), text, re.S) is not None
            case "is_function":
                return types.bare(t).form == "fn"
            case "fallible":
                return types.base_name(t) in ("Result", "Option")
        info = self.known(t)
        if name == "is_sum":
            return bool(info) and info["kind"] == "enum"
        if name == "is_product":
            return t.form == "tuple" or bool(info) and info["kind"] == "struct"
        if name in TRAITS:
            have = set((info or {}).get("trait_impls") or []) | set((info or {}).get("derives") or [])
            return any(x.split("::")[-1] in TRAITS[name] for x in have)
        if info is None:
            raise FormulaError(f"no definition of {t}")
        if name == "has_field":
            return any(f["name"] == a[1] for f in info["fields"] or [])
        return a[1] in (info["variants" if name == "has_variant" else "methods"] or [])

    def eval(self, f: tuple) -> bool:
        match f[0]:
            case "or":
                return self.eval(f[1]) or self.eval(f[2])
            case "and":
                return self.eval(f[1]) and self.eval(f[2])
            case "not":
                return not self.eval(f[1])
            case "implies":
                return not self.eval(f[1]) or self.eval(f[2])
        return self.holds(f[1], f[2:])


def outcome(text: str, context: Context) -> tuple[bool | None, str | None]:
    """(true or false, None), or (None, what is wrong)."""
    tree = parse(text)
    if isinstance(tree, str):
        return None, tree
    try:
        return context.eval(tree), None
    except FormulaError as e:
        return None, str(e)


#: Stands for a name that nothing else speaks of.
STAND_IN = "\ue000"
#: Names that no JSON text writes otherwise; those that mean something to a predicate are not stood in for.
_PLAIN = re.compile(r"[\w.: ]+", re.ASCII)
_MEANT = {"Self", "Result", "Option"}
#: Rows taken at once, and distinct entities of which the outcomes are kept.
ROWS, KEPT = 2_000, 4_096


def _outcomes(name: str | None, about: str, formulas: str, in_function: bool) -> tuple[list[str], list[bool | None], list[str | None], bool]:
    """Formulas, results, errors, and whether the spelling of a stand-in decided any."""
    x = json.loads(about)
    c = Context(name, x["type_info"], x["function_info"], in_function)
    asked = json.loads(formulas) or []
    done = [outcome(f, c) for f in asked]
    return asked, [h for h, _ in done], [e for _, e in done], c.spelled


def _evaluated(b: pa.RecordBatch, known: dict) -> pa.RecordBatch:
    """The rows of `evaluate`. Entities alike in all but module and name are evaluated once, with a stand-in for the name, but for those whose name occurs in their texts. known: outcomes kept from batch to batch."""
    about, formulas = (b[c].dictionary_encode() for c in ("about", "formulas"))
    texts, asked = about.dictionary.to_pylist(), formulas.dictionary.to_pylist()
    in_function = pc.fill_null(pc.not_equal(b["kind"], "type"), True).to_numpy(zero_copy_only=False)
    key = (about.indices.to_numpy().astype(np.int64) * len(asked) + formulas.indices.to_numpy()) * 2 + in_function
    keys, back = np.unique(key, return_inverse=True)
    shapes, found = [], []
    for k in keys.tolist():
        shape = texts[k // 2 // len(asked)], asked[k // 2 % len(asked)], bool(k % 2)
        if shape not in known:
            if len(known) >= KEPT:
                known.clear()
            known[shape] = _outcomes(STAND_IN, *shape)
        shapes.append(shape)
        found.append(known[shape])
    at = back.copy()
    names = b["name"].to_pylist()
    for i, (name, k) in enumerate(zip(names, back.tolist(), strict=True)):
        text, formula, _ = shapes[k]
        if name is None or name in text or name in formula or name in _MEANT or found[k][3] or STAND_IN in text or STAND_IN in formula or not _PLAIN.fullmatch(name):
            at[i] = len(found)
            found.append(_outcomes(name, *shapes[k]))
    many = np.array([len(f[0]) for f in found], np.int64)
    start = np.cumsum(many) - many
    n = many[at]
    row = np.repeat(np.arange(len(at)), n)
    one = pa.array(np.arange(len(row)) + np.repeat(start[at] - np.cumsum(n) + n, n))
    formula, holds, error = (pa.array([x for f in found for x in f[k]], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string())))
    stood_in = np.repeat(np.arange(len(found)) < len(keys), many) & pc.fill_null(pc.match_substring(error, STAND_IN), False).to_numpy(zero_copy_only=False)
    error = error.take(one)
    if stood_in.any() and (here := stood_in[one.to_numpy()]).any():
        error = pc.replace_with_mask(error, pa.array(here), pa.array([e.replace(STAND_IN, names[r]) for e, r in zip(error.filter(pa.array(here)).to_pylist(), row[here].tolist(), strict=True)], pa.string()))
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([*(b[c].take(row) for c in ("module", "name", "kind")), formula.take(one), holds.take(one), error], ["module", "name", "kind", "formula", "holds", "error"])


def evaluate(entities: DataFrame) -> DataFrame:
    """module, name, kind, formula, holds (null for an error) and error, a row for each formula. entities: module, name, kind, type_info (struct or null), function_info (struct or null), formulas (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                yield _evaluated(b.slice(i, ROWS), known)
        arrow.release()

    about = F.to_json(F.struct("type_info", "function_info"), {"ignoreNullFields": "false"})
    rows = entities.select("module", "name", "kind", about.alias("about"), F.coalesce(F.to_json("formulas"), F.lit("[]")).alias("formulas"))
    return rows.mapInArrow(run, "module string, name string, kind string, formula string, holds boolean, error string")


def type_constraints(entities: DataFrame) -> DataFrame:
    """Findings of formulas that fail or can't be evaluated. Variables are passed over, as are functions of which nothing is known; a type of which nothing is known is an error of its own."""
    live = entities.where(F.coalesce("kind", F.lit("function")) != "variable")
    unknown = live.where((F.col("kind") == "type") & F.col("type_info").isNull() & (F.size("formulas") > 0))
    known = live.where(F.when(F.col("kind") == "type", F.col("type_info").isNotNull()).otherwise(F.col("function_info").isNotNull()))
    bad = evaluate(known).where("holds is null or not holds")
    message = F.concat(F.lit("'"), F.col("formula"), F.when(F.col("holds").isNull(), F.concat(F.lit("' cannot be evaluated: "), F.col("error"))).otherwise("' does not hold"))
    return finding(bad, F.when(F.col("holds").isNull(), "formula-error").otherwise("formula-fails"), message, subject="name", kind="type-constraint", tier="type-formula").unionByName(finding(unknown, "type-unknown", F.concat(F.lit("type '"), F.col("name"), F.lit("' is not in the source")), subject="name", kind="type-constraint"))


def canonical_type(c: Column) -> Column:
    """A type's text in its canonical form."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else str(types.parse(t)) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(c)
