"""Source texts made of a row's values, with the facts they hold, and formulas with their outcomes, for the queries and their SQL.

In a text and its facts {k} stands for a number, {l} and {s} for names. Outcomes are SQL over the number k.
"""

from __future__ import annotations

RUST = r'''use serde::{Serialize, de::Visitor};
use std::fs;
pub(crate) use tokio_{l}::net as n;
#[derive(Debug, Clone)]
pub struct S{k}<T: Copy> { pub a: Vec<String>, pub(crate) b: HashMap<{l}, T>, }
pub struct P{k}(pub u8, &'static str);
struct Unit;
pub enum E{k} { One, Two(u8), Three { x: i8 } }
pub trait T{k}: Send + Sync { fn need(&self); }
type A{k} = Vec<u8>;
impl<T: Copy> S{k}<T> { pub fn get(&self, key: &str) -> Option<T> { if true { } None } fn hide(mut self) {} }
impl Clone for P{k} { fn clone(&self) -> Self { P } }
pub fn top_{s}(x: u32, y: &mut [u8]) -> Result<u8, E{k}> where u8: Copy { loop {} }
pub(crate) fn inner() {}
pub async fn later() {}
const K{k}: u32 = 1;
static mut G: u8 = 0;
const _: () = ();
mod deep { pub fn f{k}() {} pub mod more { pub const Z: u8 = 1; } }
#[cfg(test)]
mod tests { fn t() {} pub fn u() {} }
/* closing { */ fn last(s: &str) { let c = "}"; }
'''

FLOW9 = r'''import a/b_{l};
import a/b_{l};
forbid z/q;
export {
  S{k}(a : int, b : [string], c : ^T);
  U{k} ::= A{k}, B{k};
  f{k} : (x : int, (bool) -> void) -> [string];
  limit{k} : int;
  native now_{s} : io () -> double = Native.now;
}
V{k} ::= C{k}, D{k};
f{k}(x, g) { "a;b{" + x; /* } */ }
g{k}(y : int, z : ref int) -> bool { y > 1 } // tail
count{k} = 3;
main() { f{k}(1, \x -> {}) }
'''


def _lists(**fields: list[tuple[str, str]]) -> list[tuple[str, int, str, str]]:
    return [(f, i, name, detail) for f, rows in fields.items() for i, (name, detail) in enumerate(rows)]


def _type(kind: str, fields: str = "", variants: str = "", impls: str = "", derives: str = "", methods: str = "") -> str:
    pairs = ", ".join('{"name": "%s", "type": "%s"}' % tuple(x.split(": ")) for x in fields.split("; ") if x)
    q = lambda x: ", ".join(f'"{v}"' for v in x.split())
    return f'{{"kind": "{kind}", "fields": [{pairs}], "variants": [{q(variants)}], "trait_impls": [{q(impls)}], "derives": [{q(derives)}], "methods": [{q(methods)}]}}'


def _function(params: str = "", result: str | None = None) -> str:
    pairs = ", ".join('{"name": "%s", "type": "%s"}' % tuple(x.split(": ")) for x in params.split("; ") if x)
    return f'{{"params": [{pairs}], "return_type": {"null" if result is None else chr(34) + result + chr(34)}}}'


#: (field, pos, name, detail)
RUST_FACTS = _lists(
    public_functions=[("S{k}.get", "(self, key: &str) -> Option<T>"), ("top_{s}", "(x: u32, y: &mut [u8]) -> Result<u8, E{k}>"), ("later", "()"), ("f{k}", "()")],
    private_functions=[("S{k}.hide", "(self)"), ("P{k}.clone", "(self) -> Self"), ("inner", "()"), ("last", "(s: &str)")],
    imports=[("serde", ""), ("tokio_{l}", "")],
    state_variables=[(x, "") for x in ("S{k}", "P{k}", "Unit", "E{k}", "K{k}", "G", "Z")],
    types=[("S{k}", "struct {a: Vec<String>, b: HashMap<{l}, T>} +Debug +Clone"), ("P{k}", "struct {0: u8, 1: &str} +Clone"), ("Unit", "struct {}"), ("E{k}", "enum {One, Two, Three}"), ("T{k}", "trait {} +Send +Sync"), ("A{k}", "alias {}")],
    type_info=[
        ("S{k}", _type("struct", "a: Vec<String>; b: HashMap<{l}, T>", derives="Debug Clone", methods="get hide")), ("P{k}", _type("struct", "0: u8; 1: &str", impls="Clone", methods="clone")), ("Unit", _type("struct")),
        ("E{k}", _type("enum", variants="One Two Three")), ("T{k}", _type("trait", impls="Send Sync")), ("A{k}", _type("alias")),
    ],
    function_info=[
        ("S{k}.get", _function("self: &Self; key: &str", "Option<T>")), ("S{k}.hide", _function("self: Self")), ("P{k}.clone", _function("self: &Self", "Self")), ("top_{s}", _function("x: u32; y: &mut [u8]", "Result<u8, E{k}>")),
        ("inner", _function()), ("later", _function()), ("f{k}", _function()), ("last", _function("s: &str")),
    ],
)

FLOW9_FACTS = _lists(
    public_functions=[("S{k}", ""), ("U{k}", ""), ("f{k}", "(x : int, fn(bool) -> ()) -> Array<string>"), ("now_{s}", "() -> double")],
    private_functions=[("g{k}", "(y : int, z : ref<int>) -> bool"), ("main", "()")],
    imports=[("a/b_{l}", "")],
    state_variables=[("limit{k}", "")],
    types=[("S{k}", "struct {a: int, b: Array<string>, c: ref<T>}"), ("U{k}", "enum {A{k}, B{k}}"), ("V{k}", "enum {C{k}, D{k}}")],
    type_info=[("S{k}", _type("struct", "a: int; b: Array<string>; c: ref<T>")), ("U{k}", _type("enum", variants="A{k} B{k}")), ("V{k}", _type("enum", variants="C{k} D{k}"))],
    function_info=[("f{k}", _function("x: int; : fn(bool) -> ()", "Array<string>")), ("now_{s}", _function("", "double")), ("g{k}", _function("y: int; z: ref<int>", "bool")), ("main", _function())],
)

SOLC = """JSON AST (compact format):

{"nodeType": "SourceUnit", "nodes": [
 {"nodeType": "ImportDirective", "absolutePath": "lib/{l}.sol"},
 {"nodeType": "FunctionDefinition", "name": "free{k}", "kind": "freeFunction", "parameters": {"parameters": [{"name": "", "typeDescriptions": {"typeString": "uint256"}}, {"name": "b"}]}},
 {"nodeType": "ContractDefinition", "name": "C{s}", "nodes": [
  {"nodeType": "FunctionDefinition", "name": "f{k}", "kind": "function", "visibility": "public", "parameters": {"parameters": [{"name": "a", "typeDescriptions": {"typeString": "address"}}]}, "returnParameters": {"parameters": [{"name": "", "typeDescriptions": {"typeString": "bool"}}]}, "body": {"nodeType": "Block"}},
  {"nodeType": "FunctionDefinition", "name": "g{k}", "kind": "function", "visibility": "internal", "returnParameters": {"parameters": [{"typeDescriptions": {"typeString": "bool"}}, {"typeDescriptions": {"typeString": "uint8"}}]}},
  {"nodeType": "FunctionDefinition", "name": "", "kind": "constructor"},
  {"nodeType": "EventDefinition", "name": "{l}"}, {"nodeType": "ModifierDefinition", "name": "only{s}"},
  {"nodeType": "Other", "nodes": [{"nodeType": "VariableDeclaration", "name": "v{k}", "stateVariable": true}]}]},
 {"nodeType": "ContractDefinition", "name": "D", "nodes": [{"nodeType": "FunctionDefinition", "name": "h{k}", "kind": "function", "visibility": "external"}]}]}
"""

SOLC_FACTS = _lists(
    public_functions=[("f{k}", "(address a) -> bool"), ("h{k}", "()")], private_functions=[("free{k}", "(uint256, unknown b)"), ("g{k}", "() -> (bool, uint8)")],
    imports=[("lib/{l}.sol", "")], events=[("{l}", "")], modifiers=[("only{s}", "")], state_variables=[("v{k}", "")],
)

_NO_RETURN = "case when k % 7 = 0 then 'no return type' end"
_WITH_RETURN = "case when k % 7 <> 0 then true end"
#: (formula, SQL of the outcome, null for an error, SQL of the error)
FORMULAS: list[tuple[str, str, str]] = [
    ("has_field(Self, items)", "true", ""), ("has_field(missing)", "false", ""), ("cloneable", "k % 4 = 0", ""), ("serializable or send or sync", "false", ""), ("no_unsafe", "true", ""),
    ("fallible(return)", _WITH_RETURN, _NO_RETURN), ("fallible(Option<u8>)", "true", ""), ("equals(arg(return, 0), Vec<u8>)", _WITH_RETURN, _NO_RETURN),
    ("equals(con(field(items)), Vec)", "true", ""), ("equals(apply(Vec, u8), Vec<u8>)", "true", ""), ("equals(_, u8)", "true", ""), ("equals([u8; 32], [u8; 4])", "false", ""),
    ("is_sum(Self)", "k % 5 = 0", ""), ("is_product", "k % 5 <> 0", ""), ("is_product(product(u8, bool))", "true", ""), ("has_variant(Self, B)", "true", ""), ("has_method(Self, put)", "false", ""),
    ("equals(param(x), Vec<u8>)", "k % 2 = 0", ""), ("equals(param(1), param(x))", "true", ""), ("is_subtype(param(x), str)", "k % 2 = 1", ""), ("equals(&Vec<u8>, param(x))", "k % 2 = 0", ""),
    ("is_function(function(u8, bool))", "true", ""), ("equals(codomain(function(u8, bool)), bool)", "true", ""), ("equals(domain(fn(u8, &str) -> bool, 1), str)", "true", ""),
    ("matches(field(items), 'Vec<_>>')", "k % 2 = 0", ""), ("implies(cloneable, has_method(Self, get))", "true", ""), ("implies(has_method(Self, get), cloneable)", "k % 4 = 0", ""),
    ("not cloneable and is_sum(Self)", "k % 4 <> 0 and k % 5 = 0", ""), ("(cloneable or is_sum(Self)) and not has_method(Self, put)", "k % 4 = 0 or k % 5 = 0", ""),
    ("is_sum(Self) and fallible(return)", "case when k % 5 <> 0 then false when k % 7 <> 0 then true end", "case when k % 5 = 0 and k % 7 = 0 then 'no return type' end"),
    ("cloneable or fallible(return)", "case when k % 4 = 0 or k % 7 <> 0 then true end", "case when k % 4 <> 0 and k % 7 = 0 then 'no return type' end"),
    ("implies(is_sum(Self), fallible(return))", "case when k % 5 <> 0 or k % 7 <> 0 then true end", "case when k % 5 = 0 and k % 7 = 0 then 'no return type' end"),
    *((f, "cast(null as boolean)", f"'{e}'") for f, e in (
        ("equals(arg(field(id), 0), u8)", "no argument 0 of u32"), ("equals(field(nope), u8)", "no field ''nope''"), ("equals(param(5), u8)", "no parameter 5"), ("equals(domain(field(id), 0), u8)", "u32 is no function"), ("has_field(u8, items)", "no definition of u8"),
        ("foobar(Self)", "no predicate ''foobar''"), ("cloneable cloneable", "unexpected ''cloneable''"), ("has_field(Self, items, id)", "has_field takes 2"), ("equals(''u8", "a string is not closed"),
    )),
]
FORMULAS = [(f.replace("''", "'") if h.startswith("cast") else f, h, e) for f, h, e in FORMULAS]


def values_sql(rows: list[tuple]) -> str:
    """Rows of a VALUES clause."""
    say = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def fill_sql(text: str) -> str:
    """SQL of a text with its places filled from k, l and s."""
    return f"replace(replace(replace({text}, '{{k}}', k), '{{l}}', l), '{{s}}', s)"
