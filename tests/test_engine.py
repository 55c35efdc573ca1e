"""A project on disk, from its files to the verdict."""

from __future__ import annotations

import os
import textwrap

import pytest
from plumbline.engine import Engine
from plumbline.sources import specs
from pyspark.sql import functions as F


def put(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(textwrap.dedent(body))


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    lib = tmp_path_factory.mktemp("lib")
    put(lib, {".spec-config.yaml": "name: lib\npublic_modules: [open_mod]\n", "specs/open_mod.spec.yaml": "module: open_mod\nlanguage: rust\nsource_path: src/open_mod.rs\n", "specs/shut.spec.yaml": "module: shut\nlanguage: rust\nsource_path: src/open_mod.rs\n", "src/open_mod.rs": "pub fn f() {}\n"})
    put(root, {
        ".spec-config.yaml": f"name: app\ndependencies: {{lib: {{path: {os.path.relpath(lib, root)}}}}}\nexclude: ['**/skipped.rs']\n",
        "specs/_defaults.yaml": "language: rust\nlayer: Domain\nforbidden_external: [evil]\n",
        "specs/low/_defaults.yaml": "layer: infrastructure\n",
        "specs/vault.spec.yaml": """
            module: vault
            source_path: src/vault.rs
            source_hash: '0000000000000000'
            description: keeps things
            depends_on: [src/disk.rs, 'lib::open_mod', 'lib::shut', 'nolib::x']
            emits: [moved]
            subscribes: [lost_event]
            owns_state: [Vault]
            reads_state: [nowhere]
            invariants: [never panics]
            exposes:
              Vault: {kind: type, type_constraints: ['has_field(Self, total)', 'cloneable']}
              open: {kind: function, signature: '(path: &str) -> bool', requires: [a path], ensures: [open handle]}
              hidden: {}
              absent: {kind: function}
            protocol: {states: [shut, opened], initial: shut, terminal: [opened], transitions: [{from: shut, call: open, to: opened}], balanced_pairs: [[open, close]]}
            unknown_key: 1
            """,
        "specs/low/disk.spec.yml": "module: disk\nsource_path: src/disk.rs\ndepends_on: [src/vault.rs]\nowns_state: [Vault]\n",
        "specs/gone.spec.yaml": "module: gone\nsource_path: src/gone.rs\n",
        "specs/core.subsystem.yaml": "subsystem: core\nmodules: [src/vault.rs, src/none.rs]\nexposes: {start: {delegates_to: vault.nope}}\n",
        "specs/broken.subsystem.yaml": "subsystem: [\n",
        "src/vault.rs": "use evil::x;\n#[derive(Debug)]\npub struct Vault { pub total: u64 }\npub fn open(path: &str) -> bool { open_it(); open(path); x.unwrap(); true }\nfn hidden() {}\npub fn close() {}\n#[cfg(test)]\nmod tests {\n fn t() { close(); close(); }\n}\n",
        "src/disk.rs": "pub fn read() {}\n",
        "src/skipped.rs": "pub fn s() {}\n",
        "rules.yaml": "rules:\n- {name: no-vault, when: \"source.module == disk\", require: \"target.module != vault\", description: hands off, severity: warning}\ndisable_builtin: [context-isolation]\n",
    })
    return root


@pytest.fixture(scope="module")
def engine(spark, project):
    return Engine(spark, str(project), rules_file=str(project / "rules.yaml"))


def test_specs_with_defaults(engine):
    s = {r.module: r for r in engine.specs.collect()}
    assert set(s) == {"vault", "disk", "gone"}
    assert s["vault"].layer == "domain" and s["disk"].layer == "infrastructure" and s["disk"].language == "rust" and s["vault"].forbidden_external == ["evil"]
    assert [r.subsystem for r in engine.subsystems.collect()] == ["core"]
    assert {r.path for r in engine.sources.collect()} == {"src/vault.rs", "src/disk.rs"}


def test_check(engine):
    found = {(r.check_id, r.module, r.subject) for r in engine.check().collect()}
    for want in [
        ("no-source", "gone", "gone"), ("stale", "vault", "vault"), ("function-private", "vault", "hidden"), ("function-missing", "vault", "absent"), ("forbidden-import", "vault", "evil"), ("event-missing", "vault", "moved"),
        ("orphan-state", "vault", "nowhere"), ("ownership", "vault", "Vault"), ("ownership", "disk", "Vault"), ("rule:layer-direction", "disk", "vault"), ("rule:no-vault", "disk", "vault"), ("formula-fails", "vault", "Vault"), ("never-closed", "vault", "open"),
        ("no-emitter", "vault", "lost_event"), ("no-subscriber", "vault", "moved"), ("exclusive-ownership", "Vault", "Vault"), ("member-missing", "core", "src/none.rs"), ("delegation-no-function", "core", "start"), ("private-module", "vault", "lib::shut"), ("unknown-project", "vault", "nolib::x"),
    ]:
        assert want in found, want
    assert not {x for x in found if x[0] in ("type-missing", "signature", "rule:context-isolation", "rule:stability-direction", "unreachable", "dead-end", "protocol-call") or x[2] in ("close", "lib::open_mod")}


def test_summary_order_diff_and_invariants(engine):
    s = engine.summary().first()
    assert s.verdict == "failed" and s.exit_code == 1 and s.errors > 5
    assert {r.node: r.level for r in engine.toposort().collect()} == {"vault": -1, "disk": -1, "gone": 0}
    assert {(r.name, r.side) for r in engine.diff().where("module = 'vault' and field = 'function'").collect()} == {("Vault", "spec only"), ("absent", "spec only"), ("hidden", "spec only"), ("open", "both"), ("close", "source only")}
    assert {(r.field, r.name, r.side) for r in engine.diff().where("module = 'vault' and field <> 'function'").collect()} == {("state", "Vault", "both"), ("event", "moved", "spec only")}
    assert [(r.module, r.call, r.exists) for r in engine.transition_diff().collect()] == [("vault", "open", True)]
    assert ("src/disk.rs", "unused") in {(r.value, r.state) for r in engine.dependency_diff().collect()}
    i = {r.invariant: (r.tier, r.static) for r in engine.invariants().collect()}
    assert i == {"never panics": ("static", False), "open: requires a path": ("behavioral", None), "open: ensures open handle": ("behavioral", None)}
    projects, edges, order = engine.deps()
    assert edges == [("app", "lib")] and order == ["lib", "app"] and [p["name"] for p in projects] == ["app", "lib"]


def test_init_writes_specs_that_load(spark, project, tmp_path):
    out = tmp_path / "specs"
    records = Engine(spark, str(project)).init(str(out))
    assert {r["module"] for r in records} == {"vault", "disk"}
    back = {r.module: r for r in specs.load_specs(spark, str(out)).collect()}
    assert {e.name: e.kind for e in back["vault"].exposes} == {"Vault": "variable", "open": "function", "close": "function"} and len(back["vault"].source_hash) == 16
    assert [(p.open_fn, p.close_fn) for p in back["vault"].protocol.balanced_pairs] == [("open", "close")] and back["vault"].protocol.states == ["initial"]


def test_broken_specs_and_configuration(spark, tmp_path):
    put(tmp_path, {"a.spec.yaml": "description: no module\n"})
    with pytest.raises(ValueError, match="no module"):
        specs.load_specs(spark, str(tmp_path))
    assert specs.load_config(str(tmp_path)) == {}
    put(tmp_path, {".spec-config.yaml": "a: [\n", ".spec-config.yml": "name: x\nkeep: 1\n"})
    assert specs.load_config(str(tmp_path))["name"] == "x"
    assert specs.save_config(str(tmp_path), "y", ["t"], ".spec-config.yml") and not specs.save_config(str(tmp_path), "y", ["t"], ".spec-config.yml")
    kept = specs.parse_yaml((tmp_path / ".spec-config.yml").read_text())
    assert kept == {"name": "x", "keep": 1, "exclude": ["t"]}
    put(tmp_path, {"r.yaml": "layers: [ui, logic, data]\n", "m.yaml": "layers: {a: {can_depend_on: [b]}, b: }\n"})
    assert specs.load_rules(str(tmp_path / "r.yaml"))[2] == {"ui": ("logic", "data"), "logic": ("data",), "data": ()}
    assert specs.load_rules(str(tmp_path / "m.yaml"))[2] == {"a": ("b",), "b": ()}


TREE = '{"nodeType": "SourceUnit", "nodes": [{"nodeType": "ContractDefinition", "name": "Coin", "nodes": [{"nodeType": "FunctionDefinition", "name": "mint", "visibility": "external", "parameters": {"parameters": [{"name": "n", "typeDescriptions": {"typeString": "uint256"}}]}}]}]}'


@pytest.fixture(scope="module")
def second(tmp_path_factory):
    root = tmp_path_factory.mktemp("second")
    lib = tmp_path_factory.mktemp("shelf")
    put(lib, {"shelf.yaml": "name: shelf\n", "specs/x.spec.yaml": "module: x\nlanguage: rust\nsource_path: src/x.rs\n", "src/x.rs": "pub fn f() {}\n"})
    put(root, {
        "app.yaml": f"name: app\ndependencies: {{shelf: {os.path.relpath(lib, root)}}}\n",
        "shelf.yaml": f"name: app\ndependencies: {{shelf: {os.path.relpath(lib, root)}}}\n",
        "specs/a/mod.spec.yaml": "module: mod\nlanguage: rust\nsource_path: src/a/mod.rs\ndescription: the first\nexposes: {f: {kind: function, description: does it, ensures: [no loss]}, gone: {kind: function}}\ninvariants: [never panics, order is kept]\n",
        "specs/b/mod.spec.yaml": "module: mod\nlanguage: rust\nsource_path: src/b/mod.rs\nexposes: {g: {kind: function}}\n",
        "specs/page.spec.yaml": "module: page\nlanguage: typescript\nsource_path: src/page.ts\n",
        "specs/coin.spec.yaml": "module: coin\nlanguage: solidity\nsource_path: src/coin.sol\ndepends_on: [src/a/mod.rs]\nexposes: {mint: {kind: function, signature: '(uint256 n)'}}\n",
        "specs/uses.spec.yaml": "module: uses\nlanguage: rust\nsource_path: src/uses.rs\ndepends_on: ['shelf::x', 'shelf::src/x.rs', 'shelf::x.f', 'shelf::wrong/dir/x.rs', 'shelf::y']\n",
        "src/a/mod.rs": "use crate::uses;\npub fn f() { x.unwrap() }\n", "src/b/mod.rs": "pub fn g() {}\npub fn init() {}\npub fn teardown() {}\n", "src/page.ts": "export {}\n", "src/uses.rs": "fn h() {}\n",
        "src/coin.sol": "contract Coin { }\n", "src/coin.sol_json.ast": TREE,
    })
    return root


def test_equal_names_foreign_languages_trees_and_boundaries(spark, second):
    e = Engine(spark, str(second), config_names=("shelf.yaml", "app.yaml"))
    found = sorted((r.check_id, r.module, r.subject, r.severity) for r in e.check().collect())
    refs = [("unknown-module", "uses", v, "error") for v in ("shelf::wrong/dir/x.rs", "shelf::y")]
    assert found == sorted([("function-missing", "mod", "gone", "error"), ("no-extractor", "page", "page", "warning"), *refs])
    s = e.summary().first()
    assert (s.passed, s.errors, s.warnings, s.verdict, s.exit_code) == (4, 3, 0, "failed", 1)
    only = Engine(spark, str(second), config_names=("shelf.yaml",))
    assert only.config["name"] == "app" and Engine(spark, str(second), config_names=("none.yaml",)).config == {}
    assert {r.node: r.level for r in e.file_order().collect()} == {"src/uses.rs": 0, "src/a/mod.rs": 1, "src/b/mod.rs": 0, "src/coin.sol": 0}
    life = {r["source_path"]: r.get("protocol") for r in e.init()}
    assert life["src/b/mod.rs"] == {"states": ["initial", "ready", "terminated"], "initial": "initial", "terminal": ["terminated"], "transitions": [{"from": "initial", "call": "init", "to": "ready"}, {"from": "ready", "call": "teardown", "to": "terminated"}]} and life["src/a/mod.rs"] is None


def test_behavioral_modes_and_kept_verdicts(spark, second, tmp_path):
    e = Engine(spark, str(second), config_names=("none.yaml",), cache=str(tmp_path / "verdicts"))
    count = lambda **o: sorted((r.check_id, r.subject) for r in e.check(**o).where("kind = 'behavioral'").collect())
    static = ("static-invariant", "never panics")
    assert count() == [] and count(behavioral="dry-run") == [static] == count(behavioral="cached")
    asked = []

    def verifier(rows):
        asked.append(sorted((r.invariant, r.context) for r in rows.collect()))
        return rows.select("cache_key", (F.col("invariant") != "order is kept").alias("satisfies"))

    assert count(behavioral="full", verifier=verifier) == sorted([static, ("behavioral-invariant", "order is kept")])
    assert asked == [[("f: ensures no loss", "Module `mod`: the first\n`f`: does it"), ("order is kept", "Module `mod`: the first")]]
    count(behavioral="full", verifier=verifier)
    assert asked[1] == [] and count(behavioral="cached-only") == sorted([static, ("behavioral-invariant", "order is kept")])
    assert e.summary("cached-only").first().errors == e.summary().first().errors + 2
    assert e.behavioral_summary().first().asDict() == {"static_passed": 0, "static_failed": 1, "verified": 1, "violated": 1, "unverified": 0, "total": 3}


def test_refine_adds_to_spec_files_in_order(spark, second, tmp_path):
    import shutil

    root = tmp_path / "copy"
    shutil.copytree(second, root)
    e, seen = Engine(spark, str(root), config_names=("none.yaml",)), []

    def refiner(rows):
        seen.append({r.module.split("\x01")[0]: (r.context, r.facts) for r in rows.collect()})
        empty = F.array().cast("array<string>")
        one = rows.select("module", F.lit("f").alias("name"), F.lit("new words").alias("description"), F.array(F.lit("a lock")).alias("requires"), F.array(F.lit("no loss"), F.lit("order")).alias("ensures"), empty.alias("modifies"), empty.alias("invariants"))
        return one.unionByName(rows.select("module", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), empty.alias("requires"), empty.alias("ensures"), empty.alias("modifies"), F.array(F.lit("bounded")).alias("invariants")))

    files = e.refine(refiner)
    assert len(files) == 4 and [sorted(x) for x in seen] == [["mod", "uses"], ["coin"]]
    assert seen[1]["coin"][0] == "mod: the first a lock; no loss; order" and "pub (uint256 n)" in seen[1]["coin"][1]
    back = specs.parse_yaml((root / "specs/a/mod.spec.yaml").read_text())
    assert back["exposes"]["f"] == {"kind": "function", "description": "new words", "ensures": ["no loss", "order"], "requires": ["a lock"]} and back["exposes"]["gone"] == {"kind": "function"}
    assert back["invariants"] == ["never panics", "order is kept", "bounded"] and len(back["source_hash"]) == 16
    assert [os.path.basename(f) for f in Engine(spark, str(root), config_names=("none.yaml",)).refine(refiner, "src/uses.rs")] == ["uses.spec.yaml"]
    with pytest.raises(ValueError, match="no spec"):
        e.refine(refiner, "src/none.rs")


def test_settings_in_order():
    file = {"providers": {"b": {"model": "m", "key_env": "K"}, "a": {"model": "n"}}, "check_mode": "full", "default": "b"}
    assert specs.resolve_settings({"model": "x", "check_mode": "off"}, file, {"model": None}, {"K": "s"}) == {"model": "m", "provider": "b", "key_env": "K", "check_mode": "full", "key": "s"}
    assert specs.resolve_settings({}, {**file, "default": None}, {"model": "mine", "check_mode": "off"}, {}) == {"model": "mine", "provider": "a", "check_mode": "off"}
    assert specs.resolve_settings({"model": "x"}, {"model": "flat"}, {}, {}) == {"model": "flat"}
