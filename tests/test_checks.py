"""Checks of specs against facts, compositions, protocols, invariants."""

from __future__ import annotations

import pytest
from plumbline.operators import checks, findings, invariants, protocol

KV = "module string, value string"


@pytest.fixture
def df(spark):
    return lambda rows, ddl=KV: spark.createDataFrame(rows, ddl)


def ids(found):
    return sorted((x.module, x.subject, x.check_id) for x in found.collect())


def test_exposed_entities(df):
    e = df([("m", "T", "type", None), ("m", "V", "variable", None), ("m", "f", None, "( a )"), ("m", "g", "function", None), ("m", "h", "constructor", "x")], "module string, name string, kind string, signature string")
    names = "module string, name string"
    assert ids(checks.missing_names(e, df([("m", "X")], names), "type", "t")) == [("m", "T", "t")]
    assert ids(checks.missing_names(e, df([("m", "T")], names), "type", "t")) == []
    f = df([("m", "f", True, "(a)"), ("m", "f", False, "(b)"), ("m", "g", False, "()"), ("m", "h", True, "y")], "module string, name string, is_public boolean, signature string")
    assert ids(checks.missing_functions(e, f)) == [("m", "g", "function-private")]
    assert ids(checks.missing_functions(e, f.limit(0))) == [("m", n, "function-missing") for n in "fgh"]
    assert ids(checks.signature_mismatch(e, f)) == [("m", "h", "signature")]
    assert sorted((x.name, x.side) for x in checks.spec_diff(e, f).collect()) == [("T", "spec only"), ("V", "spec only"), ("f", "both"), ("g", "both"), ("h", "both")]


def test_missing_names_with_null_modules(df):
    e = df([("m", "T", "type"), (None, "z", "type")], "module string, name string, kind string")
    found = checks.missing_names(e, df([("m", "X"), (None, "z")], "module string, name string"), "type", "t").collect()
    assert {(x.module, x.subject) for x in found} == {("m", "T"), (None, "z")}


def test_imports(df):
    i = df([("a", "std::fs"), ("a", "core_lib::x"), ("a", "serde"), ("a", "evil"), ("b", "evil"), ("a", None)])
    assert ids(checks.undeclared_imports(i, df([("a", "src/core_lib.rs")]), df([("a", "serde")]))) == [("a", "evil", "undeclared-import")]
    assert ids(checks.forbidden_imports(i, df([("a", "vil"), ("a", "evil"), ("b", "nope")]))) == [("a", "evil", "forbidden-import")] * 2
    state = {(x.value, x.state) for x in checks.dependency_diff(df([("a", "src/core_lib.rs"), ("a", "src/idle.rs")]), i.where("value is not null"), df([("a", "evil")])).collect() if x.value != "src"}
    assert ("core_lib::x", "used") in state and ("src/idle.rs", "unused") in state and ("evil", "forbidden") in state


def test_names_state_and_events(df):
    found = ids(checks.names_diff(df([("a", "x"), ("a", "y")]), df([("a", "y"), ("a", "z"), ("b", "q")]), "event", "event"))
    assert found == [("a", "x", "event-missing"), ("a", "z", "event-undeclared")]
    owns = df([("a", "s"), ("b", "s"), ("b", "t")])
    assert ids(checks.ownership_conflicts(owns)) == [("a", "s", "ownership"), ("b", "s", "ownership")]
    assert [tuple(x) for x in checks.ownership_by_claims(owns).collect()] == [("s", 2)]
    assert ids(checks.orphan_state(df([("b", "t"), ("c", "t"), ("c", "u")]), owns)) == [("b", "t", "orphan-state"), ("c", "u", "orphan-state")]
    sub, emit = df([("a", "e1")]), df([("b", "e2")])
    assert ids(checks.event_composition(sub, emit)) == [("a", "e1", "no-emitter"), ("b", "e2", "no-subscriber")]
    assert ids(checks.event_composition(sub.limit(0), emit)) == []
    assert [tuple(x) for x in checks.emitters(df([("b", "e"), ("a", "e"), ("a", "e")])).collect()] == [("e", "a,b")]


def test_contracts(df):
    r = df([("c", "n", "p", "the vault must be open"), ("c", "k", "p", "vault paid")], "module string, name string, provider string, requirement string")
    e = df([("p", "vault", ["stays open"]), ("p", "other", [])], "provider string, entity string, texts array<string>")
    assert ids(checks.contract_gaps(r, e)) == [("c", "k", "contract")]
    t = df([("p", "do_a")], "module string, call string")
    s = df([("c", "p", "do_a"), ("c", "p", "do_b"), ("c", "q", "do_b")], "module string, provider string, value string")
    assert ids(checks.protocol_events(s, df([("p", "do_a"), ("p", "do_b"), ("q", "do_b")]), t)) == [("c", "do_b", "event-not-in-protocol")]
    pairs = df([("p", "open", "close")], "provider string, open_fn string, close_fn string")
    texts = df([("c", "p", "calls open"), ("d", "p", "close it"), ("e", "p", "open and close")], "module string, provider string, text string")
    assert ids(checks.split_pairs(texts, pairs)) == [("c", "p", "leak"), ("d", "p", "use-before-open")]


def test_subsystems_and_projects(df):
    mods = df([("a", "src/a.rs"), ("b", "src/b.rs")], "module string, source_path string")
    members = df([("s", "src/a.rs"), ("s", "b"), ("s", "src/gone.rs")])
    assert ids(checks.subsystem_missing(members, mods)) == [("s", "src/gone.rs", "member-missing")]
    d = df([("s", "x", "plain"), ("s", "y", "c.f"), ("s", "z", "a.f"), ("s", "ok", "a.g"), ("s", "ok2", "b.T.h")], "module string, name string, target string")
    fn = df([("a", "a.g"), ("b", "T.h")], "module string, name string")
    assert ids(checks.subsystem_delegation(d, members, fn)) == [("s", "x", "delegation-form"), ("s", "y", "delegation-not-member"), ("s", "z", "delegation-no-function")]
    deps = df([("a", "src/b.rs"), ("a", "src/out.rs"), ("b", "ext::x")])
    assert ids(checks.subsystem_leaks(members, deps, df([("b", "ext")]))) == [("s", "a", "subsystem-leak")]
    assert ids(checks.subsystem_forbidden(members, deps, df([("s", "out")]))) == [("s", "a", "subsystem-forbidden")]
    projects = df([("p", 0), ("bad", 2)], "project string, errors bigint")
    modules = df([("p", "a", "src/a.rs"), ("p", "b", "src/b.rs")], "project string, module string, source_path string")
    public = checks.is_public(modules.select("project", "module"), modules, df([("p", "src/a.rs")], "project string, value string"), df([], "project string, value string")).where("is_public")
    refs = df([("m", v) for v in ("p::src/a.rs", "p::b", "p::zz", "nope::a", "bad::a", "local")])
    assert ids(checks.boundaries(refs, projects, modules, public)) == [("m", "bad::a", "project-has-errors"), ("m", "nope::a", "unknown-project"), ("m", "p::b", "private-module"), ("m", "p::zz", "unknown-module")]


def test_defaults_sources_and_patches(df):
    dirs, d = df([("r/a/b",), ("r",)], "dir string"), df([("r", "rust", None), ("r/a", None, "domain"), ("r/a/b", "sol", None)], "dir string, language string, layer string")
    found = {x.dir: (x.language, x.layer) for x in checks.resolve_defaults(dirs, d, ("language", "layer")).collect()}
    assert found == {"r/a/b": ("sol", "domain"), "r": ("rust", None)}
    specs = df([("m", "rust", None), ("n", "rust", "x.rs"), ("o", "rust", "gone.rs"), ("S", "solidity", None)], "module string, language string, source_path string")
    files = df([("src/lib.rs",), ("src/main.rs",), ("x.rs",), ("S.sol",), ("src/S.sol",)], "path string")
    assert {x.module: x.path for x in checks.find_source(specs, files).collect()} == {"m": "src/lib.rs", "n": "x.rs", "S": "src/S.sol"}
    mods = df([("a", "x/a.rs", 0), ("a", "y/a.rs", 1), ("b", "x/b/mod.rs", 2)], "module string, source_path string, spec_ordinal int")
    assert {x.value: x.resolved for x in checks.resolved_deps(df([("m", "x/a.rs"), ("m", "q/b/mod.rs"), ("m", "zz")]), mods).collect()} == {"x/a.rs": "a", "q/b/mod.rs": "b", "zz": None}
    ent = "module string, name string, description string"
    assert [tuple(x) for x in checks.apply_patch(df([("m", "a", "old"), ("m", "b", "old")], ent), df([("m", "a", None)], ent)).collect()] == [("m", "a", "old")]
    items = "module string, name string, items array<string>"
    assert checks.merge_contracts(df([("m", "a", ["x", "x"]), ("m", "b", None)], items), df([("m", "a", ["y", "x", "y"])], items)).orderBy("name").collect()[0].items == ["x", "x", "y"]
    assert ids(checks.stale_specs(df([("m", "text", "00"), ("n", "text", None), ("o", None, "00")], "module string, source_text string, source_hash string"))) == [("m", "m", "stale")]


def test_protocols(df):
    p = df([("m", "init"), ("free", "any")], "module string, initial string")
    items = df([("m", "states", s) for s in ("init", "ready", "lost")] + [("m", "terminal", "ghost")], "module string, field string, value string")
    t = df([("m", 0, "init", "go", "ready"), ("m", 1, "ready", "nope", "phantom"), ("m", 2, "ready", "go", "phantom")], "module string, pos int, from_state string, call string, to_state string")
    assert ids(protocol.unknown_states(p, items, t)) == [("m", "ghost", "state-terminal"), ("m", "phantom", "state-to"), ("m", "phantom", "state-to")]
    pairs = df([("m", "go", "stop")], "module string, open_fn string, close_fn string")
    fn = df([("m", "go")], "module string, name string")
    assert ids(protocol.missing_calls(t, pairs, fn)) == [("m", "nope", "protocol-call"), ("m", "stop", "protocol-pair")]
    assert ids(protocol.unreachable(p, items, t)) == [("m", "lost", "unreachable")]
    assert ids(protocol.dead_ends(items, t)) == [("m", "lost", "dead-end")]
    code = df([("m", "go();\n// stop();\nfn stop() {}\nx.go();\nreopen_stop();"), ("n", None)], "module string, code string")
    assert ids(protocol.balanced_pairs(code, pairs)) == [("m", "go", "unbalanced")]
    names = df([("m", n) for n in ("db_open", "db_close", "lock", "unlock", "open", "init", "new", "dispose")], "module string, name string")
    assert sorted((x.open_fn, x.close_fn) for x in protocol.detect_pairs(names).collect()) == [("db_open", "db_close"), ("lock", "unlock")]
    life = protocol.lifecycle(names.unionByName(df([("n", "go"), ("o", "teardown"), ("o", "attach"), ("o", "detach")], "module string, name string"))).collect()
    assert {x.module: (x.states, x.terminal, [tuple(t) for t in x.transitions]) for x in life} == {
        "m": (["initial", "ready", "terminated"], ["terminated"], [("initial", "init", "ready"), ("ready", "dispose", "terminated")]),
        "o": (["initial", "terminated"], ["terminated"], [("initial", "teardown", "terminated")]),
    }


def test_totals_and_verdict(df):
    mods = df([("a",), ("b",), ("c",)], "module string")
    f = df([("a", "error"), ("a", "warning"), ("b", "warning")], "module string, severity string")
    v = findings.verdict(findings.totals(mods, f, df([("x", "error")], "module string, severity string"))).first()
    assert (v.passed, v.errors, v.warnings, v.verdict, v.exit_code) == (1, 2, 2, "failed", 1)
    empty = findings.verdict(findings.totals(mods.limit(0), f.limit(0))).first()
    assert (empty.passed, empty.errors, empty.warnings, empty.verdict) == (0, 0, 0, "passed")


def test_verification(df):
    wanted = df([("m", "k1"), ("m", "k2"), ("m", "k3")], "module string, cache_key string")
    cache = df([("k1", True), ("k2", False)], "cache_key string, satisfies boolean")
    got = lambda out: {x.cache_key: x.satisfies for x in out.collect()}
    assert got(invariants.verify(wanted, cache)) == {"k1": True, "k2": False, "k3": None}
    assert got(invariants.verify(wanted, cache, "off")) == dict.fromkeys(("k1", "k2", "k3"))
    from pyspark.sql import functions as F

    assert got(invariants.verify(wanted, cache, "full", lambda d: d.select("cache_key", F.lit(True).alias("satisfies"))))["k3"] is True
    b = df([("x", 0, 100), ("x", 5, None), ("y", 10, 5), ("z", None, None)], "variable string, lower bigint, upper bigint")
    assert {x.variable: x.satisfiable for x in invariants.bounds_satisfiable(b).collect()} == {"x": True, "y": False, "z": True}
