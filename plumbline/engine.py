"""Checking a project: specs against sources, in one findings table.

    engine = Engine(spark, "path/to/project")
    engine.check().show()
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import layers, paths, text
from plumbline.operators import checks, formula, graph, invariants, protocol, rules
from plumbline.operators.findings import finding, totals, union, verdict
from plumbline.sources import extract, scan, specs

_TYPE = "kind string, fields array<struct<name: string, type: string>>, variants array<string>, trait_impls array<string>, derives array<string>, methods array<string>"
_FUNCTION = "params array<struct<name: string, type: string>>, return_type string"


#: Between a module's name and the file of its spec, where specs are told apart.
MARK = "\x01"


class Engine:
    """One project: its specs (under <root>/specs), sources, rules and dependencies. What is read and extracted is written once as tables in the shared folder, so every check starts from a plain scan.

    Specs of one name are told apart by their files. `shallow` leaves out custom rules, subsystems and dependencies. `config_names` are the names a project file may have; `cache` is the folder of verdicts on invariants.
    """

    def __init__(self, spark: SparkSession, root: str, spec_dir: str = "specs", rules_file: str | None = None, excludes: list[str] = (), shallow: bool = False, config_names: tuple[str, ...] = specs.CONFIG_FILES, cache: str | None = None):
        self.spark, self.root, self.shallow, self.config_names = spark, os.path.abspath(root), shallow, config_names
        self.spec_root = os.path.join(self.root, spec_dir)
        self.cache = cache or os.path.join(self.root, ".verdicts")
        self.config = specs.load_config(self.root, config_names)
        self.excludes = [*excludes, *(self.config.get("exclude") or [])]
        rules_file = rules_file or (os.path.join(self.root, self.config["rules"]) if isinstance(self.config.get("rules"), str) else None)
        own, off, model = specs.load_rules(rules_file) if rules_file and not shallow else ([], [], None)
        self.rules, self.model = rules.configured(off, own), model if model is not None else layers.BUILT_IN

    # inputs

    @cached_property
    def specs(self) -> DataFrame:
        s = specs.load_specs(self.spark, self.spec_root)
        return graph.written(s.where(~F.coalesce(paths.excluded(F.col("source_path"), self.excludes), F.lit(False))))

    @property
    def _each(self) -> DataFrame:
        """The specs, with modules that no two share."""
        return self.specs.withColumn("module", F.concat("module", F.lit(MARK), "file"))

    @cached_property
    def subsystems(self) -> DataFrame:
        return graph.written(specs.load_subsystems(self.spark, self.spec_root))

    @cached_property
    def files(self) -> DataFrame:
        return graph.written(specs.source_files(self.spark, self.root, self.excludes))

    @cached_property
    def sources(self) -> DataFrame:
        return graph.written(specs.source_texts(self.spark, self.root, self.excludes))

    @cached_property
    def located(self) -> DataFrame:
        """module (one of _each), path, text and language of every spec's source; path is null where there is none, text where no extractor reads the language."""
        own = self.specs.select(F.concat("module", F.lit(MARK), "file").alias("key"), "module", "language", "source_path")
        found = checks.find_source(own, self.files, "key")
        named = own.select("key", F.col("language").alias("stated")).join(found, "key", "left").join(self.sources.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left")
        language = F.coalesce(F.lower("stated"), paths.detect_language(F.col("path")))
        return graph.written(named.select(F.col("key").alias("module"), "path", F.when(paths.extractor(language).isNotNull(), F.col("text")).alias("text"), language.alias("language")))

    @cached_property
    def facts(self) -> DataFrame:
        """module (one of _each), field, pos, name and detail of what is in the sources. Of Solidity the compiler's tree is read where it lies beside the source and can be, else the text."""
        return graph.written(self._facts_of(self.located.where("text is not null")))

    def _facts_of(self, src: DataFrame) -> DataFrame:
        own = lambda k: src.where(paths.extractor(F.col("language")) == k)
        parts = [extract.facts(own(k).select(F.col("module").alias("path"), "text"), k) for k in ("rust", "flow9")]
        trees = specs.syntax_trees(self.spark, self.root).select(F.col("path").alias("p"), F.col("text").alias("tree"))
        tree = graph.written(extract.facts(own("solidity").join(trees, F.col("path") == F.col("p")).select(F.col("module").alias("path"), F.col("tree").alias("text")), "solc"))
        bad = tree.where("field = 'error'").select("path")
        read = own("solidity").select("path", "module").join(trees.select("p"), F.col("path") == F.col("p"), "left_semi").join(bad.withColumnRenamed("path", "b"), F.col("module") == F.col("b"), "left_anti").select(F.col("module").alias("r"))
        sol = own("solidity").join(read, F.col("module") == F.col("r"), "left_anti").select("module", extract.solidity_columns(F.col("text")).alias("x"))
        pick = lambda field, column: sol.select(F.col("module").alias("path"), F.lit(field).alias("field"), F.posexplode(column).alias("pos", "name"), F.lit("").alias("detail"))
        zipped = sol.select("module", F.explode(F.arrays_zip(F.col("x.functions").alias("n"), F.col("x.signatures").alias("g"))).alias("z"), F.col("x.public").alias("pub"))
        solf = zipped.select(F.col("module").alias("path"), F.when(F.array_contains("pub", F.col("z.n")), "public_functions").otherwise("private_functions").alias("field"), F.lit(0).alias("pos"), F.col("z.n").alias("name"), F.col("z.g").alias("detail"))
        parts += [tree.join(bad, "path", "left_anti"), solf, *(pick(f, f"x.{f}") for f in ("imports", "events", "state_variables", "modifiers"))]
        return union(*parts).withColumnRenamed("path", "module")

    def _named(self, *fields: str) -> DataFrame:
        return self.facts.where(F.col("field").isin(*fields)).select("module", "name")

    @cached_property
    def functions(self) -> DataFrame:
        return self.facts.where(F.col("field").isin("public_functions", "private_functions")).select("module", "name", (F.col("field") == "public_functions").alias("is_public"), F.col("detail").alias("signature"))

    # checks

    @cached_property
    def _own(self) -> DataFrame:
        """Findings of single specs, by _each. `no-extractor` warnings count in no totals."""
        s, values = self._each, lambda f: self._named(f).withColumnRenamed("name", "value")
        ok = self.located.where("text is not null").select("module").join(self.facts.where("field = 'error'").select("module"), "module", "left_anti")
        live = s.join(ok, "module", "left_semi")
        lists = lambda f: specs.module_list(live, f).select("module", "value")
        ex = specs.exposes(live)
        texts = self.located.where("text is not null")
        name = F.substring_index("module", MARK, 1)
        lost = finding(self.located.where("path is null"), "no-source", F.lit("no source file"), subject=name)
        unread = finding(self.facts.where("field = 'error'"), "extraction", F.col("detail"), subject="name")
        foreign = finding(self.located.where(F.col("path").isNotNull() & paths.extractor(F.col("language")).isNull()), "no-extractor", F.concat(F.lit("no extractor for '"), F.coalesce("language", F.lit("unknown")), F.lit("'")), subject=name, severity="warning")
        stale = checks.stale_specs(s.select("module", "source_hash").join(texts.select("module", F.col("text").alias("source_text")), "module")).withColumn("subject", F.substring_index("subject", MARK, 1))
        pr, items, tr, pairs = specs.protocols(live), specs.protocol_items(live), specs.transitions(live), specs.balanced_pairs(live)
        code = texts.select("module", scan.strip_tests(F.col("text")).alias("code"))
        out = [
            lost, unread, foreign, stale,
            checks.missing_names(ex, self._named("types"), "type", "type-missing"), checks.missing_names(ex, self._named("state_variables"), "variable", "variable-missing"),
            checks.missing_functions(ex, self.functions), checks.signature_mismatch(ex, self.functions),
            checks.undeclared_imports(values("imports"), lists("depends_on"), lists("external_deps")), checks.forbidden_imports(values("imports"), lists("forbidden_deps").union(lists("forbidden_external"))),
            checks.names_diff(lists("emits"), values("events"), "event", "event"), checks.names_diff(lists("owns_state"), values("state_variables"), "state", "structural"),
            protocol.all_checks(pr, items, tr, pairs, self.functions), protocol.balanced_pairs(code, pairs),
            formula.type_constraints(self._entities(ex)),
        ]
        return graph.written(union(*out))

    @cached_property
    def _shared(self) -> DataFrame:
        """Findings of single modules that rest on others, by name."""
        s = self.specs
        lists = lambda f: specs.module_list(s, f).select("module", "value")
        ok = self.located.where("text is not null").select(F.substring_index("module", MARK, 1).alias("module")).distinct()
        live = lambda f: lists(f).join(ok, "module", "left_semi")
        return graph.written(union(
            checks.orphan_state(live("reads_state").union(live("modifies")), lists("owns_state")), checks.ownership_conflicts(lists("owns_state")),
            rules.rule_findings(rules.violations(rules.sided(self.edges, s.dropDuplicates(["module"])), self.rules, self.model)),
        ))

    def _entities(self, ex: DataFrame) -> DataFrame:
        info = lambda field, ddl, name: self.facts.where(F.col("field") == field).select(F.col("module").alias(f"{name}_m"), F.col("name").alias(f"{name}_n"), F.from_json("detail", ddl).alias(name))
        t, f = info("type_info", _TYPE, "type_info"), info("function_info", _FUNCTION, "function_info")
        e = ex.select("module", "name", F.coalesce("kind", F.lit("function")).alias("kind"), F.col("type_constraints").alias("formulas")).where(F.size("formulas") > 0)
        return e.join(t, (F.col("module") == F.col("type_info_m")) & (F.col("name") == F.col("type_info_n")), "left").join(f, (F.col("module") == F.col("function_info_m")) & (F.col("name") == F.col("function_info_n")), "left")

    @cached_property
    def edges(self) -> DataFrame:
        """src and dst of resolved dependencies between modules."""
        deps = specs.module_list(self.specs, "depends_on").where("instr(value, '::') = 0")
        return graph.written(checks.resolved_deps(deps, self.specs).where("resolved is not null").select(F.col("module").alias("src"), F.col("resolved").alias("dst")))

    def _composition(self) -> DataFrame:
        s = self.specs
        lists = lambda f: specs.module_list(s, f).select("module", "value")
        ex = specs.exposes(s).where("coalesce(kind, 'function') <> 'type'")
        e = self.edges.select(F.col("src").alias("consumer"), F.col("dst").alias("provider"))
        req = ex.select("module", "name", F.explode("requires").alias("requirement")).join(e, F.col("module") == F.col("consumer"))
        ens = ex.select(F.col("module").alias("provider"), F.col("name").alias("entity"), F.col("ensures").alias("texts"))
        texts = ex.select("module", F.explode(F.concat("requires", "ensures")).alias("text")).join(e, F.col("module") == F.col("consumer")).select("module", "provider", "text")
        subs = lists("subscribes").join(e, F.col("module") == F.col("consumer")).select("module", "provider", "value")
        claims = finding(checks.ownership_by_claims(lists("owns_state")), "exclusive-ownership", F.concat(F.lit("owners: "), F.col("owners").cast("string")), module="value", subject="value", tier="smt")
        return union(checks.event_composition(lists("subscribes"), lists("emits")), checks.contract_gaps(req, ens), checks.protocol_events(subs, lists("emits"), specs.transitions(s)), checks.split_pairs(texts, specs.balanced_pairs(s).withColumnRenamed("module", "provider")), claims)

    def _subsystems(self) -> DataFrame:
        sub, s = self.subsystems, self.specs
        members = sub.select(F.col("subsystem").alias("module"), F.explode("modules").alias("value"))
        delegations = sub.select(F.col("subsystem").alias("module"), F.explode("exposes").alias("e")).select("module", F.col("e.name").alias("name"), F.col("e.delegates_to").alias("target")).where("target is not null")
        deps, ext = specs.module_list(s, "depends_on"), specs.module_list(s, "external_deps")
        return union(checks.subsystem_missing(members, s), checks.subsystem_delegation(delegations, members, specs.exposes(s)), checks.subsystem_leaks(members, deps, ext), checks.subsystem_forbidden(members, deps, sub.select(F.col("subsystem").alias("module"), F.explode("forbidden_deps").alias("value"))))

    @cached_property
    def _boundaries(self) -> DataFrame | None:
        """Cross-project references, with every dependency project checked by itself, all in one query."""
        if self.shallow or not self.config.get("dependencies"):
            return None
        projects, _ = specs.project_graph(self.root, self.config_names)
        errors, modules, explicit, members = [], [], [], []
        for p in projects[1:]:
            e = Engine(self.spark, p["root"], shallow=True, config_names=self.config_names)
            at = F.lit(p["name"]).alias("project")
            errors.append(e.check().agg(F.count_if(F.col("severity") == "error").alias("errors")).select(at, "errors"))
            modules.append(e.specs.select(at, "module", "source_path"))
            members.append(e.subsystems.select(at, F.explode("modules").alias("value")))
            explicit += [(p["name"], m) for m in p["public_modules"] or []]
        all_ = union(*modules)
        public = checks.is_public(all_.select("project", "module"), all_, self.spark.createDataFrame(explicit, "project string, value string"), union(*members)).where("is_public")
        return graph.written(checks.boundaries(specs.module_list(self.specs, "depends_on"), union(*errors), all_, public))

    # behavioral

    @cached_property
    def _checked(self) -> DataFrame:
        return graph.written(self.invariants())

    def verdicts(self, mode: str = "cached-only", verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The invariants of no static check with context and satisfies, by the folder of verdicts and, in mode full, by the verifier, whose answers the folder keeps. See invariants.verify."""
        mode = invariants.MODES[mode.lower()]
        wanted = self._checked.where("static is null or tier <> 'static'")
        s = self.specs
        context = invariants.description_context(wanted.select("module", "invariant"), s.groupBy("module").agg(F.max("description").alias("description")), specs.exposes(s).groupBy("module", "name").agg(F.max("description").alias("description")))
        wanted = graph.written(wanted.join(context.withColumnsRenamed({"module": "cm", "invariant": "ci"}), (F.col("module") == F.col("cm")) & (F.col("invariant") == F.col("ci")), "left").drop("cm", "ci"))
        known = graph.written(invariants.read_cache(self.spark, self.cache))
        out = graph.written(invariants.verify(wanted, known, mode, verifier))
        if mode == "full" and verifier is not None:
            invariants.write_cache(out.join(known.select(F.col("cache_key").alias("k")), F.col("cache_key") == F.col("k"), "left_anti"), self.cache)
        return out

    def _behavioral(self, mode: str, verifier: Callable[[DataFrame], DataFrame] | None) -> DataFrame | None:
        if self.shallow or invariants.MODES[mode.lower()] == "off":
            return None
        return invariants.outcomes(self._checked, self.verdicts(mode, verifier).select("cache_key", "satisfies").distinct())

    def behavioral_summary(self, mode: str = "cached-only", verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Counts of the outcomes of all invariants."""
        known = self.verdicts(mode, verifier).select(F.col("cache_key").alias("k"), F.col("satisfies").alias("cached")).distinct()
        return invariants.summary(self._checked.join(known, F.col("cache_key") == F.col("k"), "left"))

    # results

    def _beyond(self, behavioral: str, verifier: Callable[[DataFrame], DataFrame] | None) -> list[DataFrame]:
        """Findings that belong to no single module."""
        parts = [self._composition(), *([] if self.shallow else [self._subsystems()]), self._boundaries, self._behavioral(behavioral, verifier)]
        return [p for p in parts if p is not None]

    def check(self, behavioral: str = "off", verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """All findings. behavioral: off, dry-run, cached-only or full."""
        own = self._own.withColumn("module", F.substring_index("module", MARK, 1))
        return union(own, self._shared, *self._beyond(behavioral, verifier))

    def summary(self, behavioral: str = "off", verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Totals and verdict of what check() finds. Specs without findings pass, and so do subsystems; findings by name count for the first spec of the name; `no-extractor` warnings count nowhere."""
        each = self._each.select("module")
        first = each.groupBy(F.substring_index("module", MARK, 1).alias("n")).agg(F.min("module").alias("first"))
        shared = self._shared.join(first, F.col("module") == F.col("n"))
        shared = shared.select(*[F.col("first").alias("module") if c == "module" else c for c in self._own.columns])
        counted = self._own.where("check_id <> 'no-extractor'").unionByName(shared)
        modules = each
        if not self.shallow:
            of = lambda df: df.withColumn("module", F.concat(F.lit(MARK), "module"))
            modules, counted = modules.union(of(self.subsystems.select(F.col("subsystem").alias("module")).distinct())), counted.unionByName(of(self._subsystems()))
        rest = [self._composition(), self._boundaries, self._behavioral(behavioral, verifier)]
        return verdict(totals(modules, counted, union(*[p for p in rest if p is not None])))

    # other commands

    def diff(self) -> DataFrame:
        """module, field (function, state or event), name and side of what specs and sources have."""
        name = F.substring_index("module", MARK, 1)
        s = self._each.join(self.located.where("text is not null").select("module"), "module", "left_semi")
        lists = lambda f: specs.module_list(s, f).select("module", F.col("value").alias("name"))
        sides = {"function": (specs.exposes(s), self.functions.where("is_public")), "state": (lists("owns_state"), self._named("state_variables")), "event": (lists("emits"), self._named("events"))}
        return union(*(checks.spec_diff(a, b).select(name.alias("module"), F.lit(k).alias("field"), "name", "side") for k, (a, b) in sides.items()))

    def dependency_diff(self) -> DataFrame:
        s = self._each
        lists = lambda f: specs.module_list(s, f).select("module", "value")
        return checks.dependency_diff(lists("depends_on"), self._named("imports").withColumnRenamed("name", "value"), lists("forbidden_deps")).withColumn("module", F.substring_index("module", MARK, 1))

    def transition_diff(self) -> DataFrame:
        """Protocol transitions, each with whether its function is in the source."""
        return checks.transition_marks(specs.transitions(self._each), self.functions).withColumn("module", F.substring_index("module", MARK, 1))

    def refine(self, refiner: Callable[[DataFrame], DataFrame], only: str | None = None) -> list[str]:
        """Adds to specs what the refiner says of them and returns the files rewritten.

        Specs are taken level by level, dependencies first and cycles last, so that a spec's context holds what was added to
        those it depends on. The refiner is a function of rows module (one of _each), text, facts (a summary), spec (JSON) and context that returns module,
        name (of an entity, null for the module itself), description, requires, ensures, modifies and invariants; nothing is
        taken away. `only` is the one source_path to refine.
        """
        s = self._each.where(F.col("source_path") == only) if only is not None else self._each
        if only is not None and s.isEmpty():
            raise ValueError(f"no spec for {only}")
        text = self.located.where("text <> ''").select(F.col("module").alias("tm"), "text", "path")
        facts = extract.summarize(self.facts.withColumnRenamed("module", "path"), 20_000).select(F.col("module").alias("sm"), F.col("text").alias("facts"))
        keyed = checks.resolved_deps(specs.module_list(self._each, "depends_on").where("instr(value, '::') = 0"), self.specs.withColumn("key", F.concat("module", F.lit(MARK), "file")), "key").where("resolved is not null")
        edges = graph.written(keyed.select(F.col("module").alias("src"), F.col("resolved").alias("dst")))
        levels = graph.topo_levels(edges, self._each.select(F.col("module").alias("node")), ignore_self=True)
        todo = graph.written(s.join(text, F.col("module") == F.col("tm")).join(facts, F.col("module") == F.col("sm"), "left").join(levels.select(F.col("node").alias("n"), "level"), F.col("module") == F.col("n")).select("module", "file", "path", "text", "facts", "level", F.to_json(F.struct("description", "exposes", "invariants")).alias("spec")))
        lines = graph.written(self._each.select("module", F.concat(F.substring_index("module", MARK, 1), F.lit(": "), F.coalesce("description", F.lit(""))).alias("line")))
        deps = edges.select(F.col("src").alias("module"), F.col("dst").alias("value"), F.lit(0).alias("pos"))
        done: list[str] = []
        for level in sorted((r[0] for r in todo.select("level").distinct().collect()), key=lambda k: (k < 0, k)):
            rows = todo.where(F.col("level") == level)
            context = checks.dep_context(deps, lines).withColumnRenamed("module", "cm")
            given = graph.written(refiner(rows.join(context, F.col("module") == F.col("cm"), "left").drop("cm", "file", "path", "level")))
            added = given.groupBy(F.col("module").alias("am")).agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.concat("requires", "ensures")))), "; ").alias("added"))
            lines = graph.written(lines.join(added, F.col("module") == F.col("am"), "left").select("module", F.concat_ws(" ", "line", "added").alias("line")))
            # a spec file is rewritten where it lies, one at a time
            sums = rows.join(given.groupBy(F.col("module").alias("gm")).agg(F.collect_list(F.struct("name", "description", "requires", "ensures", "modifies", "invariants")).alias("given")), F.col("module") == F.col("gm")).select("file", "spec", "given", paths.source_hash(F.col("text")).alias("hash"))
            for r in sums.toLocalIterator():
                done.append(specs.refined(r.file, json.loads(r.spec), [x.asDict() for x in r.given], r.hash))
        return sorted(done)

    def toposort(self) -> DataFrame:
        """node and level, dependencies first; -1 for what is on or above a cycle."""
        return graph.topo_levels(self.edges, self.specs.select(F.col("module").alias("node")))

    def file_order(self) -> DataFrame:
        """node (a source's path) and level, files that others speak of first; -1 as in toposort."""
        src = self.sources.select("path", "text")
        return graph.topo_levels(extract.file_edges(src), src.select(F.col("path").alias("node")))

    def deps(self) -> tuple[list[dict[str, Any]], list[tuple[str, str]], list[str]]:
        """Projects and edges between them, and the projects in order, dependencies first; a cycle is an error."""
        projects, edges = specs.project_graph(self.root, self.config_names)
        order, stuck = graph.kahn_order([p["name"] for p in projects], edges)
        if stuck:
            raise ValueError(f"projects depend on each other: {', '.join(stuck)}")
        return projects, edges, order

    def invariants(self) -> DataFrame:
        """Invariants of all modules with tier, static outcome and cache key."""
        ex = specs.exposes(self._each)
        every = invariants.collect(specs.module_list(self._each, "invariants").select("module", F.col("value").alias("invariant")), ex)
        return invariants.checked(every, self.located.select("module", F.col("text").alias("code"))).withColumn("module", F.substring_index("module", MARK, 1))

    def init(self, out: str | None = None) -> list[dict[str, Any]]:
        """Spec skeletons of the sources that have no spec; written under out if given. One record per source file comes to the driver, as files are written there."""
        src = self.sources
        e = Engine.__new__(Engine)
        e.spark, e.root, e.excludes = self.spark, self.root, self.excludes
        e.__dict__["located"] = src.select(F.col("path").alias("module"), "path", "text", "language")
        skeleton = extract.skeleton(e._named("types"), e.functions, e._named("state_variables"))
        pairs, life = protocol.detect_pairs(e.functions), protocol.lifecycle(e.functions)
        hashes = src.select(F.col("path").alias("module"), "language", paths.source_hash(F.col("text")).alias("source_hash"))
        rows = skeleton.groupBy("module").agg(F.collect_list(F.struct("name", "kind")).alias("entities")).join(hashes, "module").join(pairs.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("open_fn", "close_fn"))).alias("pairs")), "module", "left").join(life, "module", "left").collect()
        records = []
        for r in sorted(rows, key=lambda r: r.module):
            s: dict[str, Any] = {"module": os.path.splitext(os.path.basename(r.module))[0], "language": r.language, "source_path": r.module, "source_hash": r.source_hash, "exposes": {x.name: {"kind": x.kind} for x in sorted(r.entities)}}
            if r.states:
                s["protocol"] = {"states": r.states, "initial": "initial", "terminal": r.terminal, "transitions": [{"from": t.from_state, "call": t.call, "to": t.to_state} for t in r.transitions], "balanced_pairs": [[p.open_fn, p.close_fn] for p in r.pairs or []]}
                s["protocol"] = {k: v for k, v in s["protocol"].items() if v}
            records.append(s)
        if out:
            specs.write_specs(records, out)
        return records

    def save_config(self, name: str, excludes: list[str] = ()) -> bool:
        """Adds name and excludes to the project file, the first of the names that is there; True if it changed."""
        there = [n for n in self.config_names if os.path.exists(os.path.join(self.root, n))]
        return specs.save_config(self.root, name, list(excludes), (there or list(self.config_names))[0])


__all__ = ["Engine", "text"]
