"""The operators applied to the role bindings, by the keys of the survey's index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import layers, paths, text
from plumbline.functions.batches import spread
from plumbline.operators import checks, formula, graph, invariants, protocol, rules
from plumbline.operators.findings import totals, union, verdict
from plumbline.plans import snippets
from plumbline.plans.bind import INVARIANTS, role
from plumbline.sources import extract, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*roles: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of the roles' DataFrames under its name."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(role(spark, sf_dir, r) for r in roles))

        QUERIES[f.__name__] = run
        return run

    return wrap


SHORT = ("module", "subject", "severity", "check_id", "message")


def _short(df: DataFrame) -> DataFrame:
    return df.select(*SHORT)


# architecture


@query("edges", "modules")
def rule_violations(edges, modules):
    return rules.violations(rules.sided(edges, modules))


def _one_rule(name: str) -> None:
    def run(edges, modules):
        return rules.violations(rules.sided(edges, modules), [r for r in rules.BUILT_IN if r.name == name]).select("src", "dst", "severity")

    run.__name__ = name.split("-")[0] + "_violations"
    query("edges", "modules")(run)


for _r in rules.BUILT_IN:
    _one_rule(_r.name)


@query("region")
def layer_pairs(region):
    listed = layers.linear_pairs(region.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("layer"))).withColumn("model", F.lit("linear"))
    return listed.unionByName(layers.model_pairs(region.sparkSession, layers.BUILT_IN).withColumn("model", F.lit("built-in")))


# names and paths


@query("modules")
def module_name(modules):
    path = F.when(F.col("spec_ordinal") % 3 == 0, F.regexp_replace("source_path", r"\.rs$", "/mod.rs")).when(F.col("spec_ordinal") % 3 == 1, F.concat("source_path", F.lit(".rs"))).otherwise(F.col("source_path"))
    return modules.select(path.alias("path"), paths.module_name(path).alias("name"))


@query("cross_refs")
def cross_ref(refs):
    return refs.select("module", "value", paths.ref_project(F.col("value")).alias("project"), paths.ref_module(F.col("value")).alias("target"))


@query("project_modules", "explicit_public", "public_members")
def is_public(modules, explicit, members):
    return checks.is_public(modules.select("project", "module"), modules, explicit, members)


@query("modules")
def exclude_glob(modules):
    return modules.where(~paths.excluded(F.col("source_path"), ["src/Brand#1*/**", "**/m?.rs", "src/*/m*7.rs"])).select("module", "source_path")


@query("documents")
def source_hash(documents):
    return documents.select("doc_id", paths.source_hash(F.col("text")).alias("hash"))


@query("pages")
def detect_language(pages):
    path = F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".rs", ".sol", ".flow", ".tsx", ".js", ".py", "", ".test.ts"))), (F.col("page_id") % 8 + 1).cast("int")))
    language = paths.detect_language(path)
    return pages.select(path.alias("path"), language.alias("language"), paths.extractor(language).alias("extractor"))


@query("modules")
def find_source(modules):
    n = F.col("spec_ordinal")
    specs = modules.select(F.upper("module").alias("module"), F.when(n % 3 == 0, "rust").when(n % 3 == 1, "solidity").otherwise("typescript").alias("language"), F.when(n % 5 == 0, F.col("source_path")).alias("source_path"))
    own = F.upper("module")
    files = modules.select(F.explode(F.array(F.when(n % 2 == 0, F.col("source_path")), F.when(n % 4 == 0, F.concat(F.lit("src/"), "module", F.lit(".rs"))), F.when(n % 4 == 1, F.concat(F.lit("src/"), own, F.lit(".sol"))), F.when(n % 2 == 1, F.concat(own, F.lit(".sol"))), F.when(n % 4 == 2, F.concat(own, F.lit(".ts"))), F.lit("src/main.rs"))).alias("path")).where("path is not null")
    return checks.find_source(specs, files)


@query("specs")
def stale_specs(specs):
    return checks.stale_specs(specs).select("module", "severity", "message")


@query("customer")
def sanitize_names(customer):
    return customer.select("c_custkey", text.sanitize_name(F.concat("c_name", F.lit("-é "), "c_mktsegment")).alias("name"))


# declared against extracted


@query("exposes", "x_types")
def missing_types(exposes, facts):
    return _short(checks.missing_names(exposes, facts, "type", "type-missing"))


@query("exposes", "x_vars")
def missing_vars(exposes, facts):
    return _short(checks.missing_names(exposes, facts, "variable", "variable-missing"))


@query("exposes", "x_functions")
def missing_functions(exposes, functions):
    return _short(checks.missing_functions(exposes, functions))


@query("exposes", "x_functions")
def signature_mismatch(exposes, functions):
    return _short(checks.signature_mismatch(exposes, functions))


@query("imports", "depends_on", "external_deps")
def undeclared_imports(imports, deps, external):
    return _short(checks.undeclared_imports(imports, deps, external))


@query("imports", "forbidden_deps")
def forbidden_imports(imports, forbidden):
    return _short(checks.forbidden_imports(imports, forbidden))


@query("declared_events", "actual_events")
def events_diff(declared, actual):
    return _short(checks.names_diff(declared, actual, "event", "event"))


@query("owns_state", "actual_state")
def state_diff(declared, actual):
    return _short(checks.names_diff(declared, actual, "state", "structural"))


@query("reads_state", "owns_state")
def orphan_state(reads, owns):
    return _short(checks.orphan_state(reads, owns))


@query("owns_state")
def ownership_conflicts(owns):
    return _short(checks.ownership_conflicts(owns))


@query("owns_state")
def ownership_smt(owns):
    return checks.ownership_by_claims(owns)


@query("exposes", "x_functions")
def spec_diff(exposes, functions):
    return checks.spec_diff(exposes, functions.where("is_public"))


def _names(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("value", "name")


@query("owns_state", "actual_state", "declared_events", "actual_events")
def list_diff(state, actual_state, events, actual_events):
    """Sides of state and events, as spec_diff has those of functions."""
    side = lambda f, a, b: checks.spec_diff(_names(a), _names(b)).select(F.lit(f).alias("field"), "module", "name", "side")
    return side("state", state, actual_state).unionByName(side("event", events, actual_events))


@query("depends_on", "imports", "forbidden_deps")
def dependency_diff(deps, imports, forbidden):
    return checks.dependency_diff(deps, imports, forbidden)


@query("transitions", "p_functions")
def transition_marks(transitions, functions):
    return checks.transition_marks(transitions, functions)


# composition


@query("member_deps", "project_modules")
def resolved_deps(deps, modules):
    return checks.resolved_deps(deps, modules.withColumn("spec_ordinal", F.substring("module", 2, 9).cast("int")))


@query("requires", "ensured")
def contract_gaps(requires, ensured):
    return _short(checks.contract_gaps(requires, ensured.groupBy("provider", "entity").agg(F.collect_list("text").alias("texts"))))


@query("step_subscribes", "step_emits", "transitions")
def protocol_events(subscribes, emits, transitions):
    return _short(checks.protocol_events(subscribes.withColumn("provider", F.col("module")), emits, transitions.select("module", F.substring("call", 4, 99).alias("call"))))


@query("call_lines", "event_pairs")
def split_pairs(lines, pairs):
    texts = lines.select(F.concat(F.lit("v"), F.element_at(F.split("line", r"[(]"), -1)).alias("module"), F.col("module").alias("provider"), F.col("line").alias("text"))
    return _short(checks.split_pairs(texts, pairs.withColumnRenamed("module", "provider")))


@query("subscribes", "emits")
def event_composition(subscribes, emits):
    return _short(checks.event_composition(subscribes, emits))


@query("emits")
def emitters(emits):
    return checks.emitters(emits)


@query("members", "project_modules")
def subsystem_missing(members, modules):
    return _short(checks.subsystem_missing(members, modules))


@query("delegations", "members", "member_functions")
def subsystem_delegation(delegations, members, functions):
    return _short(checks.subsystem_delegation(delegations, members, functions))


@query("members", "member_deps", "member_external")
def subsystem_leaks(members, deps, external):
    return _short(checks.subsystem_leaks(members, deps, external))


@query("members", "member_deps", "member_forbidden")
def subsystem_forbidden(members, deps, forbidden):
    return _short(checks.subsystem_forbidden(members, deps, forbidden))


@query("cross_refs", "projects", "project_modules", "explicit_public", "public_members")
def boundaries(refs, projects, modules, explicit, members):
    public = checks.is_public(modules.select("project", "module"), modules, explicit, members).where("is_public")
    return _short(checks.boundaries(refs, projects, modules, public))


# protocols


@query("protocols", "protocol_items", "transitions")
def protocol_states(protocols, items, transitions):
    return _short(protocol.unknown_states(protocols, items, transitions))


@query("transitions", "call_pairs", "p_functions")
def protocol_calls(transitions, pairs, functions):
    return _short(protocol.missing_calls(transitions, pairs, functions))


@query("protocols", "protocol_items", "transitions")
def protocol_unreachable(protocols, items, transitions):
    return _short(protocol.unreachable(protocols, items, transitions))


@query("protocol_items", "transitions")
def protocol_deadends(items, transitions):
    return _short(protocol.dead_ends(items, transitions))


@query("call_lines", "event_pairs")
def balanced_pairs(lines, pairs):
    return _short(protocol.balanced_pairs(lines.groupBy("module").agg(F.array_join(F.collect_list("line"), "\n").alias("code")), pairs))


@query("call_lines")
def count_calls(lines):
    code = lines.groupBy("module").agg(F.array_join(F.collect_list("line"), "\n").alias("code"))
    return code.select("module", *(text.count_calls(F.col("code"), F.lit(n)).alias(n) for n in ("signup", "click", "view", "purchase", "error")))


@query("x_functions")
def detect_pairs(functions):
    k = F.substring("name", 2, 9).cast("int")
    verbs = F.array(*(F.lit(v) for pair in protocol.PAIRS for v in pair))
    return protocol.detect_pairs(functions.select("module", F.concat(F.when(k % 3 == 0, "db_").otherwise(""), F.element_at(verbs, (k % 20 + 1).cast("int"))).alias("name")))


@query("x_functions")
def detect_lifecycle(functions):
    """Each part that a supplier has stands for a well-known name, or none."""
    names = F.array(*map(F.lit, (*protocol.INIT, *protocol.SHUTDOWN, "run", "open", "close")))
    named = functions.select("module", F.element_at(names, (F.substring("name", 2, 9).cast("int") % 12 + 1).cast("int")).alias("name"))
    found = protocol.lifecycle(named)
    return found.select("module", F.array_join("states", ",").alias("states"), F.array_join("terminal", ",").alias("terminal"), F.array_join(F.transform("transitions", lambda t: F.concat_ws(" ", t["from_state"], t["call"], t["to_state"])), ",").alias("transitions"))


# totals


def _all(modules: DataFrame, edges: DataFrame) -> DataFrame:
    return rules.rule_findings(rules.violations(rules.sided(edges, modules)))


@query("modules", "edges")
def summary_totals(modules, edges):
    return totals(modules, _all(modules, edges)).select(*(F.col(c).cast("bigint") for c in ("passed", "errors", "warnings")))


@query("modules", "edges", "subscribes", "emits")
def verdict_query(modules, edges, subscribes, emits):
    return verdict(totals(modules, _all(modules, edges), checks.event_composition(subscribes, emits))).select(*(F.col(c).cast("bigint").alias(c) for c in ("passed", "errors", "warnings")), "verdict", "exit_code")


QUERIES["verdict"] = QUERIES.pop("verdict_query")


@query("exposes", "x_types", "x_vars", "x_functions", "owns_state", "reads_state")
def findings_all(exposes, types, variables, functions, owns, reads):
    return union(checks.missing_names(exposes, types, "type", "type-missing"), checks.missing_names(exposes, variables, "variable", "variable-missing"), checks.missing_functions(exposes, functions), checks.signature_mismatch(exposes, functions), checks.ownership_conflicts(owns), checks.orphan_state(reads, owns)).groupBy("check_id", "kind", "tier", "severity").agg(F.count("*").alias("n"), F.count_distinct("module").alias("modules"))


@query("exposes", "x_types", "supplier", "nation")
def project_errors(exposes, types, supplier, nation):
    bad = checks.missing_names(exposes, types, "type", "type-missing")
    at = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("m"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("project"))
    return bad.join(at, F.col("module") == F.col("m")).groupBy("project").agg(F.count_if(F.col("severity") == "error").alias("errors")).where("errors > 0")


# graphs


@query("edges")
def in_degree(edges):
    return graph.in_degree(edges)


@query("dag", "dag_nodes")
def topo_levels(edges, nodes):
    return graph.topo_levels(edges, nodes)


@query("cyclic", "dag_nodes")
def graph_cycles(edges, nodes):
    return graph.cycles(edges, nodes)


@query("nation_edges")
def project_closure(edges):
    return graph.closure(edges, edges.select(F.col("src").alias("node")).distinct())


@query("dag", "dag_nodes")
def impact(edges, nodes):
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(back, nodes).select(F.col("start").alias("module"), F.col("node").alias("dependent"), "distance")


@query("dag", "dag_nodes")
def dep_tree(edges, nodes):
    return graph.dep_tree(edges, nodes)


# invariants and text


@query("documents")
def estimate_tokens(documents):
    return documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("documents")
def word_scan(documents):
    return documents.select("doc_id", *(text.has_word(F.col("text"), w).alias(f"has_{w}") for w in ("token", "on", "License")))


@query("documents")
def cache_keys(documents):
    return documents.select("doc_id", text.cache_key(F.col("text"), F.lit("never panics")).alias("cache_key"))


@query("invariant_texts")
def classify_invariants(texts):
    return texts.select("invariant", text.classify_invariant(F.col("invariant")).alias("tier"))


def _code(code: str, *more: str) -> F.Column:
    """The code with a line that breaks one rule or another."""
    return F.concat(code, F.element_at(F.array(*map(F.lit, more)), F.length(code) % len(more) + 1))


@query("documents")
def static_checks(documents):
    """Every invariant text on every document, whose code is stripped once."""
    code = _code("text", "\n x.unwrap();", "\nunsafe { }", "\n  // panic!() unsafe", '\nlet s = "x.unwrap() unsafe";', '\nif t.contains("panic!(") { x.unwrap() }', "\n#[cfg(test)]\nmod t {\n fn a() { b.unwrap() }\n}")
    clean = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("module"), scan.strip_to_code(code).alias("code"))
    return clean.select("module", "code", F.explode(F.array(*map(F.lit, INVARIANTS))).alias("invariant")).select("module", "invariant", text.static_result(F.col("invariant"), F.col("code")).alias("satisfied"))


@query("exposes", "requires")
def collect_invariants(exposes, requires):
    module_level = exposes.where("kind = 'variable'").select("module", F.col("description").alias("invariant")).where("invariant is not null")
    entities = exposes.where("description is not null").select("module", "name", "kind", F.array(F.col("description")).alias("requires"), F.array(F.col("signature")).alias("ensures"))
    return invariants.collect(module_level, entities)


@query("invariants")
def behavioral_summary(inv):
    code = _code("code", " x.unwrap();", " unsafe { }", "")
    rows = inv.select("module", "invariant", text.classify_invariant(F.col("invariant")).alias("tier"), text.static_result(F.col("invariant"), code).alias("static"), F.when(F.length("code") % 4 > 0, F.length("code") % 4 > 1).alias("cached"))
    return invariants.summary(rows)


@query("wanted", "verdict_cache")
def cache_join(wanted, cache):
    return checks.cached_verdicts(wanted, cache)


@query("documents")
def strip_strings(documents):
    code = F.concat(F.lit('let a = "x'), F.col("doc_id").cast("string"), F.lit('\\\\\\" y"; b \\" c "d\n'), "text", F.lit('\n"open // \\'))
    return documents.select("doc_id", scan.strip_strings(code).alias("code"))


@query("pages")
def strip_comments(pages):
    code = F.concat("html", F.lit('\n"// kept \\" /* kept */" // gone\n/* gone " */ a /* '), F.col("url"))
    return pages.select("page_id", scan.strip_comments(code).alias("code"))


@query("documents")
def strip_tests(documents):
    deep = F.expr("repeat('{ if a { b() } ', doc_id % 4)")
    code = F.concat(F.lit("fn a() { x.unwrap(); }\n  #[cfg(test)]\nmod tests {\n fn t() { "), deep, F.lit(" panic!()\n"), F.expr("repeat(' } ', doc_id % 4)"), F.lit("\n } }\n"), "text")
    return documents.select("doc_id", scan.strip_tests(code).alias("code"))


# patches and defaults


@query("exposes")
def apply_patch(exposes):
    k = F.substring("name", 2, 9).cast("int")
    return checks.apply_patch(exposes.select("module", "name", "description"), exposes.where(k % 3 == 0).select("module", "name", F.when(k % 2 == 0, F.concat(F.lit("new "), "name")).alias("description")))


@query("lineitem")
def merge_contracts(lineitem):
    m, n = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    rows = lineitem.select(m.alias("module"), n.alias("name"), F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("v")).alias("x"), "l_linenumber")
    gather = lambda df: df.groupBy("module", "name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("items"))
    out = checks.merge_contracts(gather(rows.where("l_linenumber <= 4")), gather(rows.where("l_linenumber >= 3")))
    return out.select("module", "name", F.array_join("items", ",").alias("items"))


@query("modules")
def apply_enrichment(modules):
    k, some = F.col("spec_ordinal"), lambda *x: F.array(*x).cast("array<string>")
    specs = modules.select("module", "layer", some(F.lit("old"), "context").alias("forbidden_deps"))
    patch = modules.where(k % 3 > 0).select("module", F.when(k % 2 == 0, "Application").alias("layer"), F.when(k % 5 > 0, some("context", F.lit("new"))).alias("forbidden_deps"))
    return checks.apply_enrichment(specs, patch).withColumn("forbidden_deps", F.array_join("forbidden_deps", ","))


@query("exposes")
def merge_refinement(exposes):
    """requires, ensures and modifies of entities, to which a patch adds without repetition."""
    k, some = F.substring("name", 2, 9).cast("int"), lambda *x: F.array_compact(F.array(*x)).cast("array<string>")
    lists = ("requires", "ensures", "modifies")
    own = exposes.select("module", "name", some("description").alias("requires"), some("signature", "signature").alias("ensures"), some().alias("modifies"))
    patch = exposes.where(k % 3 > 0).select("module", "name", some(F.lit("a lock"), "description", F.lit("a lock")).alias("requires"), some("signature").alias("ensures"), some(F.when(k % 2 == 0, F.col("name"))).alias("modifies"))
    return checks.merge_lists(own, patch, ("module", "name"), lists).select("module", "name", *(F.array_join(c, ",").alias(c) for c in lists))


@query("described", "described_entities")
def description_context(modules, entities):
    texts = ("open: requires a path", "close: ensures no loss", "order is kept", "openly: ensures nothing")
    return invariants.description_context(modules.select("module", F.explode(F.array(*map(F.lit, texts))).alias("invariant")), modules, entities)


@query("dag", "modules")
def dep_context(edges, modules):
    deps = edges.select(F.col("src").alias("module"), F.col("dst").alias("value"), F.substring("dst", 2, 9).cast("int").alias("pos"))
    return checks.dep_context(deps, modules.select("module", F.concat("module", F.lit(": "), "source_path").alias("line")))


@query("spec_dirs", "defaults")
def defaults_resolve(dirs, defaults):
    return checks.resolve_defaults(dirs, defaults, ("language", "layer", "stability"))


@query("modules", "part", "spec_dirs", "defaults")
def apply_defaults(modules, part, dirs, defaults):
    found = checks.resolve_defaults(dirs, defaults, ("language", "layer", "stability")).withColumn("external", F.array(F.lit("serde"), F.lit("clap"), F.lit("serde")))
    p = part.select(F.col("p_partkey").alias("k"), F.concat(F.lit("root/"), "p_brand", F.lit("/"), "p_type").alias("dir"))
    specs = modules.join(p, F.col("spec_ordinal") == F.col("k")).select("module", "dir", F.lit(None).cast("string").alias("language"), "layer", "stability", F.when(F.col("k") % 3 == 0, F.array(F.lit("tokio"), F.lit("clap"), F.lit("tokio"))).alias("external"))
    out = checks.apply_defaults(specs, found, ("language", "layer", "stability"), ("external",))
    return out.withColumn("external", F.array_join("external", ","))


# extraction


@query("pages")
def import_roots(pages):
    code = F.concat(F.lit("use std::fs;\nuse crate::a;\nuse "), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/.?#=&-]+", "::"), F.lit(";\nuse serde::{Deserialize};\nuse serde;\n"))
    return pages.select("page_id", F.array_join(extract.import_roots(code), ",").alias("roots"))


@query("documents")
def internal_deps(documents):
    code = F.concat(F.lit("use crate::alpha::X;\n let y = crate::"), F.col("lang"), F.lit("::f(crate::"), F.col("source"), F.lit("); crate::alpha;\n"), F.regexp_replace("text", " on ", " crate::on "))
    return documents.select("doc_id", F.array_join(extract.internal_deps(code), ",").alias("deps"))


@query("crate_files")
def file_edges(files):
    return extract.file_edges(files)


@query("crate_files")
def file_levels(files):
    return graph.topo_levels(extract.file_edges(files), files.select(F.col("path").alias("node")))


@query("events")
def regex_extract(events):
    code = F.concat(F.lit("contract C"), F.col("user_id").cast("string"), F.lit(" {\n  uint256 public total;\n  event E_"), "event_type", F.lit("(uint x);\n  function f_"), F.col("event_id").cast("string"), F.lit("(uint a) "), F.when(F.col("event_id") % 3 == 0, "public view").when(F.col("event_id") % 3 == 1, "internal").otherwise(""), F.lit(" returns (bool) { }\n  modifier onlyOwner { _; }\n}\n"))
    return events.select("event_id", extract.solidity_columns(code).alias("x")).select("event_id", "x.name", *(F.array_join(f"x.{c}", ",").alias(c) for c in ("functions", "public", "events", "state_variables", "modifiers")))


@query("x_types", "x_functions", "x_vars")
def skeleton(types, functions, variables):
    return extract.skeleton(types, functions, variables)


def _filled(template: str, k: str, name: str, other: str) -> F.Column:
    out = F.lit(template)
    for place, value in (("{k}", F.col(k).cast("string")), ("{l}", F.col(name)), ("{s}", F.col(other).cast("string"))):
        out = F.replace(out, F.lit(place), value)
    return out


@query("events")
def x_solc(events):
    """A compiler's tree for each event."""
    return extract.facts(events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), _filled(snippets.SOLC, "event_id", "event_type", "user_id").alias("text")), "solc")


def _documented(documents: DataFrame, template: str) -> DataFrame:
    """A source file for each document, whose text is its first comment."""
    return documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" */\n"), _filled(template, "doc_id", "lang", "source")).alias("text"))


@query("documents")
def x_rust(documents):
    return extract.facts(_documented(documents, snippets.RUST), "rust")


@query("documents")
def x_flow9(documents):
    return extract.facts(_documented(documents, snippets.FLOW9), "flow9")


@query("lineitem")
def greedy_budget(lineitem):
    blocks = lineitem.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("module"), (F.col("l_linenumber") % 5).cast("int").alias("priority"), F.col("l_partkey").alias("pos"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("block"))
    return extract.greedy_budget(blocks, 60)


# formulas


@query("lineitem")
def formula_logic(lineitem):
    """Connectives over true, false and errors, each of which a formula of its own gives."""
    outcome = lambda c: F.when(c.isNull(), "equals(field(none), u8)").when(c, "no_unsafe").otherwise("not no_unsafe")
    a = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_quantity") > 25)
    b = F.when(F.col("l_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("l_discount") > 0.05)
    table = lineitem.select(F.monotonically_increasing_id().cast("string").alias("name"), a.cast("boolean").alias("a"), b.cast("boolean").alias("b"), outcome(a).alias("x"), outcome(b).alias("y"))
    texts = {"a_and_b": F.concat_ws(" and ", "x", "y"), "a_or_b": F.concat_ws(" or ", "x", "y"), "not_a": F.concat(F.lit("not ("), "x", F.lit(")")), "a_implies_b": F.concat(F.lit("implies("), "x", F.lit(", "), "y", F.lit(")"))}
    counted = table.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    asked = counted.select(F.to_json(F.struct("a", "b", "n")).alias("module"), F.lit("T").alias("name"), F.lit("type").alias("kind"), F.lit(None).cast("struct<kind:string>").alias("type_info"), F.lit(None).cast("struct<params:array<string>>").alias("function_info"), F.array(*texts.values()).alias("formulas"), F.array(*texts.values()).alias("texts"))
    held = formula.evaluate(asked.drop("texts")).join(asked.select(F.col("module").alias("m"), "texts"), F.col("module") == F.col("m"))
    per = held.groupBy("module").agg(*(F.max_by("holds", F.col("formula") == F.col("texts")[i]).alias(k) for i, k in enumerate(texts)))
    return per.select(F.from_json("module", "a boolean, b boolean, n bigint").alias("r"), *texts).select("r.a", "r.b", *texts, "r.n")


@query("part")
def type_matches(part):
    """Patterns held against a field's type by the formulas' own `matches`."""
    t = F.concat(F.lit("Vec<"), "p_type", F.lit(", "), "p_brand", F.lit(">"))
    patterns = ("Vec<_>", "_, Brand#1_>", "Vec<SMALL, Brand#2>", "Map<_>")
    info = F.struct(F.lit("struct").alias("kind"), F.array(F.struct(F.lit("t").alias("name"), t.alias("type"))).alias("fields"))
    asked = spread(part).select(F.col("p_partkey").cast("string").alias("module"), F.lit("T").alias("name"), F.lit("type").alias("kind"), info.alias("type_info"), F.lit(None).cast("struct<params:array<string>>").alias("function_info"), F.array(*(F.lit(f"matches(field(t), '{p}')") for p in patterns)).alias("formulas"))
    held = formula.evaluate(asked)
    return held.groupBy(F.col("module").cast("bigint").alias("p_partkey")).agg(*(F.bool_or(F.when(F.col("formula") == f"matches(field(t), '{p}')", F.col("holds"))).alias(f"m{i}") for i, p in enumerate(patterns)))


def _entities(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    field = lambda n, t: F.struct(F.lit(n).alias("name"), t.alias("type"))
    arg = F.when(k % 2 == 0, "Vec<u8>").otherwise("&str")
    return part.select(
        F.concat(F.lit("m"), k.cast("string")).alias("module"), F.concat(F.lit("T"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "function").otherwise("type").alias("kind"),
        F.struct(F.when(k % 5 == 0, "enum").otherwise("struct").alias("kind"), F.array(field("items", F.concat(F.lit("Vec<"), arg, F.lit(">"))), field("id", F.lit("u32"))).alias("fields"), F.array(F.lit("A"), F.lit("B")).alias("variants"), F.array(F.lit("Debug")).alias("trait_impls"), F.when(k % 4 == 0, F.array(F.lit("Clone"))).otherwise(F.array().cast("array<string>")).alias("derives"), F.array(F.lit("get")).alias("methods")).alias("type_info"),
        F.struct(F.array(F.struct(F.lit("self").alias("name"), F.lit("&Self").alias("type")), F.struct(F.lit("x").alias("name"), arg.alias("type"))).alias("params"), F.when(k % 7 > 0, "Result<Vec<u8>, Error>").alias("return_type")).alias("function_info"),
        F.array(*(F.lit(f) for f, _, _ in snippets.FORMULAS)).alias("formulas"),
    )


@query("part")
def formula_eval(part):
    return formula.evaluate(_entities(spread(part)))


@query("part")
def type_constraints(part):
    return formula.type_constraints(_entities(spread(part))).select(*SHORT)


@query("part")
def type_parse(part):
    t = F.concat(F.lit("Map< "), "p_type", F.lit(" ,fn( &mut "), F.regexp_replace("p_brand", "#", ""), F.lit(",&'a  str)->[u8;32] , (Vec<_>,()), [ "), "p_type", F.lit("<fn()> ] >"))
    return spread(part).select("p_partkey", formula.canonical_type(t).alias("canonical"))


@query("bounds")
def bounds_sat(bounds):
    return invariants.bounds_satisfiable(bounds)


@query("bounds", "wished_bounds")
def bounds_implied(bounds, wished):
    return invariants.implied(bounds, wished)
