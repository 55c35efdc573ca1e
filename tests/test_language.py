"""The rule language and the type-formula language."""

from __future__ import annotations

import pytest
from plumbline.functions import layers
from plumbline.operators import formula, rules, types

MODULES = [("a", "src/a.rs", "rust", "infrastructure", "pay", "stable"), ("b", "src/b.rs", "rust", "domain", "users", "volatile"), ("c", "src/c.rs", "rust", "presentation", "web", "normal"), ("d", "src/d.rs", "rust", None, None, None)]
DDL = "module string, source_path string, language string, layer string, context string, stability string"


def _violated(spark, edges, *own, **options):
    pairs = rules.sided(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(MODULES, DDL))
    return sorted((r.src, r.dst, r.rule) for r in rules.violations(pairs, own or rules.BUILT_IN, **options).collect())


def test_built_in_rules(spark):
    found = _violated(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("a", "d"), ("d", "b"), ("a", "gone")])
    assert found == [("a", "b", "context-isolation"), ("a", "b", "layer-direction"), ("a", "b", "stability-direction"), ("b", "a", "context-isolation")]


@pytest.mark.parametrize(
    ("require", "holds"),
    [
        ("true", True), ("false", False), ("source.layer == domain", False), ("source.layer == 'infrastructure'", True), ('target.context != "users"', False),
        ("(false OR true) AND true", True), ("(true or false) and false", False), ("not source.context.exists", False), ("!false", True), ("source.name == a && target.module == b", True),
        ("source.path == 'src/a.rs' || false", True), ("source.context == 'a OR b'", False), ("source.stability == stability::STABLE", True), ("none", False), ("anything", True),
    ],
)
def test_conditions(spark, require, holds):
    assert bool(_violated(spark, [("a", "b")], rules.Rule("r", require))) is not holds


def test_errors_gates_parity_and_models(spark):
    v = rules.violations(rules.sided(spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame(MODULES, DDL)), [rules.Rule("r", "source.colour == red", severity="warning"), rules.Rule("q", "false", "source.layer == domain"), rules.Rule("w", "false", severity="warning")]).collect()
    assert sorted((x.rule, x.severity) for x in v) == [("r", "error"), ("w", "warning")] and any("colour" in x.message for x in v)
    grouped = rules.Rule("g", "(false OR false) AND true")
    assert _violated(spark, [("a", "b")], grouped) and not _violated(spark, [("a", "b")], grouped, parity=True)
    assert [r.name for r in rules.configured(["layer-direction"], [grouped])] == ["context-isolation", "stability-direction", "g"]
    only = rules.Rule("l", "source.layer.can_depend_on(target.layer)")
    assert not _violated(spark, [("a", "b")], only, model=layers.linear(["Infrastructure", "Domain"]))
    assert _violated(spark, [("a", "c")], only, model=layers.explicit({"infrastructure": ["domain"], "domain": ["presentation"]}))
    assert _violated(spark, []) == []


@pytest.mark.parametrize("text", ["Vec<String>", "Result<Vec<u8>, Error>", "&mut Self", "[u8]", "[u8; 32]", "(u32, String)", "fn(u32) -> bool", "()", "_", "Map<K, fn(A, B) -> Vec<C>>"])
def test_types_round_trip(text):
    assert str(types.parse(text)) == text and types.parse(str(types.parse(text))) == types.parse(text)


def test_type_arguments_split_outside_brackets():
    assert types.split_args("A<B, C>, fn(x, y) -> z, [u8; 2], (p, q)") == ["A<B, C>", "fn(x, y) -> z", "[u8; 2]", "(p, q)"]


TYPE = {"kind": "struct", "fields": [{"name": "errors", "type": "Vec<String>"}, {"name": "warnings", "type": "Vec<String>"}], "variants": [], "trait_impls": ["Debug"], "derives": ["Clone", "Debug"], "methods": ["check"]}
FUNCTION = {"params": [{"name": "self", "type": "&Self"}, {"name": "spec", "type": "&ModuleSpec"}], "return_type": "Result<CheckResult>"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("has_field(Self, errors)", True), ("has_field(Self, nonexistent)", False), ("cloneable", True), ("serializable", False), ("not serializable", True), ("has_method(Self, check)", True), ("has_variant(Self, A)", False),
        ("equals(con(field(errors)), Vec)", True), ("equals(arg(field(errors), 0), String)", True), ("serializable or cloneable", True), ("serializable and cloneable", False), ("implies(serializable, has_field(Self, nope))", True),
        ("is_product(Self)", True), ("is_sum(Self)", False), ("(serializable or cloneable) and cloneable", True), ("matches(field(errors), 'Vec<_>')", True), ("is_subtype(Self, _)", True), ("no_unsafe", True), ("is_function(fn(X) -> ())", True),
    ],
)
def test_formulas_on_a_type(text, want):
    assert formula.outcome(text, formula.Context("Checker", TYPE, None, False)) == (want, None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("equals(con(return), Result)", True), ("equals(con(return), Vec)", False), ("equals(arg(return, 0), CheckResult)", True), ("fallible(return)", True), ("equals(param(spec), ModuleSpec)", True), ("equals(param(spec), &ModuleSpec)", True), ("equals(param(0), Self)", True),
        ("equals(domain(fn(A, B) -> C, 1), B)", True), ("equals(codomain(fn(A) -> C), C)", True), ("equals(apply(Vec, u8), Vec<u8>)", True), ("is_product(product(A, B))", True),
    ],
)
def test_formulas_on_a_function(text, want):
    assert formula.outcome(text, formula.Context("check", None, FUNCTION, True)) == (want, None)


@pytest.mark.parametrize("text", ["foobar(Self)", "equals('open, Self)", "has_field(Self)", "cloneable cloneable", "equals(arg(u8, 0), u8)", "field(errors)", "", "equals(param(9), u8)"])
def test_formula_errors_are_data(text):
    holds, error = formula.outcome(text, formula.Context("check", None, FUNCTION, True))
    assert holds is None and error


def test_type_constraints(spark):
    t = "struct<kind:string,fields:array<struct<name:string,type:string>>,variants:array<string>,trait_impls:array<string>,derives:array<string>,methods:array<string>>"
    f = "struct<params:array<struct<name:string,type:string>>,return_type:string>"
    rows = [("m", "T", "type", TYPE, None, ["cloneable", "send", "oops("]), ("m", "U", "type", None, None, ["cloneable"]), ("m", "f", None, None, FUNCTION, ["fallible(return)", "is_function(return)"]), ("m", "g", "function", None, None, ["fallible(return)"]), ("m", "v", "variable", None, None, ["nonsense("]), ("m", "n", "type", TYPE, None, None)]
    df = spark.createDataFrame(rows, f"module string, name string, kind string, type_info {t}, function_info {f}, formulas array<string>")
    assert sorted((x.subject, x.check_id) for x in formula.type_constraints(df).collect()) == [("T", "formula-error"), ("T", "formula-fails"), ("U", "type-unknown"), ("f", "formula-fails")]
    assert formula.evaluate(df.limit(0)).count() == 0


def test_entities_alike_are_evaluated_once(spark, monkeypatch):
    t, f = "struct<kind:string,fields:array<struct<name:string,type:string>>,variants:array<string>,trait_impls:array<string>,derives:array<string>,methods:array<string>>", "struct<params:array<struct<name:string,type:string>>,return_type:string>"
    # names that the texts speak of, that mean something to a predicate, that no JSON text has as they are, and others
    names = ["Vec", "u8", "x", "Result", "Option", "Self", "_", "", 'a"b', "a\nb", "é", formula.STAND_IN, *(f"T{i}" for i in range(40))]
    info, one = ("struct", [("x", "Vec<u8>"), ("y", None)], None, ["Send"], [], ["get"]), ([("self", "&Self"), ("é", "u8")], None)
    asked = ["equals(Self, Vec)", "equals(con(field(x)), Self)", "fallible(Self)", "has_field(Self, x)", "has_method(u8, get)", "equals(arg(Self, 0), u8)", "equals(domain(Self, 0), u8)", "matches(Self, 'T1_')", "not (send)", "equals(T7, Self)", "equals(return, u8)", "oops", "matches(field(x), 'Vec_')"]
    rows = [(f"m{i}", n, kind, x, y, q) for i, (n, kind, x, y, q) in enumerate((n, kind, x, y, q) for n in names for kind, x, y in (("type", info, None), ("function", info, one), (None, None, one)) for q in (asked, asked[:7], [], None))]
    df = spark.createDataFrame(rows, f"module string, name string, kind string, type_info {t}, function_info {f}, formulas array<string>")
    want = []
    for r in df.collect():
        d = r.asDict(recursive=True)
        c = formula.Context(r.name, d["type_info"], d["function_info"], r.kind != "type")
        want += [(r.module, r.name, r.kind, q, *formula.outcome(q, c)) for q in r.formulas or []]
    assert sorted(map(repr, map(tuple, formula.evaluate(df).collect()))) == sorted(map(repr, want))
    calls = []
    monkeypatch.setattr(formula, "outcome", lambda q, c: calls.append(q) or (True, None))
    one = {"about": ['{"type_info":null,"function_info":null}'] * 1000, "formulas": ['["send","sync"]'] * 1000}
    batch = formula.pa.RecordBatch.from_pydict({"module": ["m"] * 1000, "name": [f"N{i}" for i in range(1000)], "kind": ["type"] * 1000, **one})
    assert formula._evaluated(batch, {}).num_rows == 2000 and len(calls) == 2
