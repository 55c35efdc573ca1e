"""Extractors, scanners and text columns."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from plumbline.functions import paths, text
from plumbline.sources import extract, flow9, rust, scan
from pyspark.sql import functions as F

RUST = '''
use std::fs;
use serde::{Deserialize, Serialize as S};
use {tokio::sync, crate::own};
// pub fn commented() {}
#[derive(Clone, Debug)]
pub struct Point<T> { pub x: Vec<T>, y: (u32, String) }
struct Pair(u8, pub String);
impl Default for Late { fn default() -> Self { Late } }
pub enum Late { One, Two(u8), Three { a: u8 } }
pub trait Shape: Draw + Send { fn area(&self) -> f64; }
impl Shape for Point<u8> { fn area(&self) -> f64 { 0.0 } }
impl Point<u8> { pub fn new(x: u32) -> Result<Self, Error> { let s = "fn fake() {"; todo!() } pub(crate) async fn hidden(&mut self) {} }
pub fn free<'a>(a: &'a str, b: [u8; 32]) -> bool where u8: Copy { true }
type Alias = Vec<u8>;
const LIMIT: usize = 3;
pub static NAME: &str = "x";
mod inner { pub fn nested() {} }
#[cfg(test)]
mod tests { pub fn not_me() {} }
'''


def test_rust():
    f = rust.extract(RUST, "m")
    assert f.imports == ["serde", "tokio"]
    assert f.public_functions == ["Point.new", "free", "nested"]
    assert set(f.private_functions) == {"Late.default", "Point.area", "Point.hidden"}
    assert f.state_variables == ["Point", "Pair", "Late", "LIMIT", "NAME"]
    p = f.types["Point"]
    assert p.fields == [("x", "Vec<T>"), ("y", "(u32, String)")] and p.derives == ["Clone", "Debug"] and p.trait_impls == ["Shape"]
    assert f.types["Pair"].fields == [("0", "u8"), ("1", "String")] and f.types["Late"].variants == ["One", "Two", "Three"] and f.types["Late"].trait_impls == []
    assert f.types["Shape"].trait_impls == ["Draw", "Send"] and f.types["Alias"].kind == "alias"
    assert f.functions["Point.new"] == ([("x", "u32")], "Result<Self, Error>") and f.functions["Point.hidden"][0] == [("self", "&mut Self")]
    assert f.functions["free"][1] == "bool"


FLOW = '''
import a/b; // why
export {
  Shape ::= Circle, Square;
  Circle(r : double);
  area : (s : Shape) -> double;
  native now : () -> double = Native.now;
  limit = 3;
}
area(s) { switch (s) { Circle(r) : r; Square() : 1.0; } }
helper(x : int) -> int { x + 1 }
'''


def test_flow9():
    f = flow9.extract(FLOW, "m")
    assert f.imports == ["a/b"] and "limit" in f.state_variables
    assert "area" in f.public_functions and "now" in f.public_functions and f.private_functions == ["helper"]
    assert f.types["Shape"].variants == ["Circle", "Square"] and "Circle" in f.types


SOLIDITY = '''
import "./Other.sol";
import {X} from "lib/X.sol";
contract Vault {
    mapping (address => uint) balances;
    uint256 public total;
    event Moved(uint amount);
    event Closed();
    modifier onlyOwner { _; }
    function open(uint a) public returns (bool) { }
    function shut() external { }
    function inner() internal { }
    function plain() { }
}
'''


def test_solidity(spark):
    x = spark.createDataFrame([(SOLIDITY,), ("",), (None,)], "t string").select(extract.solidity_columns(F.col("t")).alias("x")).collect()
    v = x[0].x
    assert v.name == "Vault" and v.functions == ["open", "shut", "inner", "plain"] and v.public == ["open", "shut"] and v.events == ["Moved", "Closed"] and v.modifiers == ["onlyOwner"]
    assert v.imports == ["./Other.sol", "lib/X.sol"] and v.state_variables == ["balances", "total"] and v.signatures[0] == "(uint a) -> bool"
    assert x[1].x.name is None and x[1].x.functions == []


def test_facts_of_broken_null_and_repeated_files(spark):
    src = spark.createDataFrame([("a.rs", "pub fn f() {}"), ("a.rs", "pub fn f() {}"), ("n.rs", None), ("e.rs", ""), ("x.rs", "pub fn ((((")], "path string, text string")
    rows = extract.facts(src, "rust").collect()
    assert sum(r.field == "public_functions" and r.name == "f" for r in rows) == 2 and not [r for r in rows if r.path in ("n.rs", "e.rs")]
    assert extract.facts(src.limit(0), "flow9").count() == 0


def test_solc_tree(spark):
    one = '{"nodeType":"SourceUnit","nodes":[{"nodeType":"ImportDirective","absolutePath":"x.sol"},{"nodeType":"ContractDefinition","name":"C","nodes":[{"nodeType":"FunctionDefinition","kind":"function","name":"f","visibility":"public"},{"nodeType":"FunctionDefinition","kind":"receive","name":"r"},{"nodeType":"EventDefinition","name":"E"}]}]}'
    both = '{"sources": {"a.sol": {"AST": %s}, "b.sol": {"ast": {"nodeType": "FunctionDefinition", "name": "free"}}}}' % one
    rows = extract.facts(spark.createDataFrame([("1", "JSON AST:\n" + one), ("2", None), ("3", "{"), ("4", both)], "path string, text string"), "solc").collect()
    own = [("public_functions", "f"), ("imports", "x.sol"), ("events", "E")]
    assert [(r.field, r.name) for r in rows if r.path == "1"] == own and {r.field for r in rows if r.path in "23"} == {"error"}
    assert sorted((r.field, r.name) for r in rows if r.path == "4") == sorted([*own, ("private_functions", "free")])


def test_imports_skeleton_and_budget(spark):
    c = spark.createDataFrame([("use serde::A;\npub use tokio::x;\nuse std::fs;\nuse serde::B;\n let a = crate::m::f(crate::k);",)], "t string").select(extract.import_roots(F.col("t")).alias("r"), extract.internal_deps(F.col("t")).alias("d")).first()
    assert c.r == ["serde", "tokio"] and c.d == ["m", "k"]
    two = "module string, name string"
    s = extract.skeleton(spark.createDataFrame([("m", "T"), ("m", "U")], two), spark.createDataFrame([("m", "T", True), ("m", "f", True), ("m", "g", False)], two + ", is_public boolean"), spark.createDataFrame([("m", "f"), ("m", "U")], two))
    assert {x.name: x.kind for x in s.collect()} == {"T": "type", "f": "function", "U": "variable"}
    b = spark.createDataFrame([("m", 0, 0, "aaaa"), ("m", 0, 1, "b" * 20), ("m", 1, 0, "cc"), ("m", 1, 1, "é")], "module string, priority int, pos int, block string")
    assert [tuple(x) for x in extract.greedy_budget(b, 11).collect()] == [("m", "aaaa\ncc\né", 1)]


def test_scanners(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("x")).first().x
    text = 'a /* x */ b // c\n"// kept" /* open'
    assert scan.comments_stripped(text) == 'a  b \n"// kept" ' == one(text, scan.strip_comments)
    tests = "fn a() {}\n#[cfg(test)]\nmod t {\n fn b() {}\n}\nfn c() {}"
    assert one(tests, scan.strip_tests) == "fn a() {}\n}\nfn c() {}" and one(None, scan.strip_tests) is None
    assert one('x("a\\"b") y "" z "open\nnext', scan.strip_strings) == 'x("") y "" z "\nnext'
    assert one('"' + "x" * 200_000 + '" y', scan.strip_strings) == '"" y' and one("/*" + "x" * 200_000 + "*/ y", scan.strip_comments) == " y"
    assert "unwrap" not in one('let s = "x.unwrap()";\n// y.unwrap()\nif t.contains("z.unwrap()") {}', scan.strip_to_code)


@pytest.mark.parametrize("seed", range(40))
def test_comment_scanner_matches_its_column(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(['"', "\\", "/", "*", "\n", "a", "//", "/*", "*/"]) for _ in range(r.randint(0, 25))) for _ in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.strip_comments(F.col("t")).alias("x")).collect()
    assert all(x.x == scan.comments_stripped(x.t) for x in rows)


@pytest.mark.parametrize(("code", "n"), [("f();", 1), ("fn f() {}", 0), ("x.f();\n// f()\n# f()\nf(f());", 3), ("reopen_f(1)", 1), ("", 0), (None, 0)])
def test_count_calls(spark, code, n):
    assert spark.createDataFrame([(code,)], "t string").select(text.count_calls(F.col("t"), F.lit("f")).alias("n")).first().n == n


def test_text_columns(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("a unsafe{", lambda c: text.has_word(c, "unsafe")) and not one("unsafe_x", lambda c: text.has_word(c, "unsafe"))
    assert one("f: requires no panic", text.classify_invariant) == "behavioral" and one("It Never Panics", text.classify_invariant) == "static" and one("sorted", text.classify_invariant) == "behavioral"
    assert one("x.expect(1)", lambda c: text.static_result(F.lit("no panic"), c)) is False and one("x", lambda c: text.static_result(F.lit("returns result"), c)) is None
    assert one("abcde", text.estimate_tokens) == 101 and one("a-b é_1", text.sanitize_name) == "a_b_é_1"
    assert one("src/x/mod.rs", paths.module_name) == "x" and one("a.rs.rs", paths.module_name) == "a" and one("mod.rs", paths.module_name) == "mod"
    assert one("p::a::b", paths.ref_project) == "p" and one("p::a::b", paths.ref_module) == "a::b" and one("a", paths.ref_project) is None
    assert one("a/b.tsx", paths.detect_language) == "typescript" and one("b.zig", paths.detect_language) == "zig" and one("none", paths.detect_language) is None
    assert one("SOL", paths.extractor) == "solidity" and one("java", paths.extractor) is None
    assert one("hello", paths.source_hash) == "2cf24dba5fb0a30e"
    assert one("src/a/b.rs", lambda c: paths.excluded(c, ["**/b.*"])) and not one("src/a/b.rs", lambda c: paths.excluded(c, ["src/*.rs"])) and not one("x", lambda c: paths.excluded(c, []))


def test_strip_tests_holds_few_texts_at_once(monkeypatch):
    runs, freed = [], []
    monkeypatch.setattr(scan.F, "arrow_udf", lambda run, ddl: runs.append(run) or (lambda c: c))
    monkeypatch.setattr(scan.arrow, "release", lambda: freed.append(1))
    monkeypatch.setattr(scan.arrow, "PART", 100)
    scan.strip_tests(None)
    texts = ["fn a() {}\n#[cfg(test)]\nmod t {\n}\nx" * (k % 4) or None for k in range(50)] + ["y" * 500, ""]
    want = [None if t is None else scan.tests_stripped(t) for t in texts]
    assert runs[0](pa.array(texts)).to_pylist() == want and freed
    assert runs[0](pa.array(texts).slice(7, 9)).to_pylist() == want[7:16] and runs[0](pa.array([], pa.string())).to_pylist() == []
    cuts = list(scan.arrow.parts([60, 60, 30, 500, 0, 100, 1], 100))
    assert cuts == [(0, 1), (1, 3), (3, 4), (4, 6), (6, 7)] and list(scan.arrow.parts([], 100)) == []


def test_facts_come_in_bounded_batches():
    class Sources:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, ddl):
            return run

    files = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(1000)] + ["empty"], "text": [f"pub fn f{k}() {{}}" for k in range(1000)] + [None]}, pa.schema({"path": pa.string(), "text": pa.string()}))
    found = list(extract.facts(Sources(), "rust")(iter([files])))
    assert max(len(set(b["path"].to_pylist())) for b in found) <= 200
    assert {r["path"] for b in found for r in b.to_pylist() if r["field"] == "public_functions"} == {f"p{k}" for k in range(1000)}
