"""Checks of declared specs against extracted facts. Each takes DataFrames with the columns named and returns findings; nothing is deduplicated that the question does not deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, text
from plumbline.operators.findings import finding, union


def _says(before: str, *columns_and_text: str | Column) -> Column:
    return F.concat(F.lit(before), *[x if isinstance(x, Column) else F.lit(x) for x in columns_and_text])


def _anti(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    r = right.select(*[F.col(b).alias(f"r_{b}") for b in keys.values()])
    on = None
    for a, b in keys.items():
        c = F.col(a) == F.col(f"r_{b}")
        on = c if on is None else on & c
    return left.join(r, on, "left_anti")


def missing_names(exposes: DataFrame, facts: DataFrame, kind: str, check_id: str) -> DataFrame:
    """Exposed entities (module, name, kind) of a kind that the facts (module, name) do not have."""
    return finding(_anti(exposes.where(F.col("kind") == kind), facts, {"module": "module", "name": "name"}), check_id, _says(f"{kind} '", F.col("name"), "' is not in the source"), subject="name")


def missing_functions(exposes: DataFrame, functions: DataFrame) -> DataFrame:
    """Exposed entities that are neither type nor variable and are private or absent; public wins where a function is both. functions: module, name, is_public."""
    known = functions.groupBy(F.col("module").alias("m"), F.col("name").alias("n")).agg(F.bool_or("is_public").alias("p"))
    own = exposes.where(~F.coalesce("kind", F.lit("function")).isin("type", "variable")).join(known, (F.col("module") == F.col("m")) & (F.col("name") == F.col("n")), "left").where(~F.coalesce("p", F.lit(False)))
    return finding(own, F.when(F.col("p").isNull(), "function-missing").otherwise("function-private"), _says("function '", F.col("name"), F.when(F.col("p").isNull(), "' is not in the source").otherwise("' is private")), subject="name")


def signature_mismatch(exposes: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions whose signature, white space aside, is not the declared one."""
    f = functions.where("is_public").select(F.col("module").alias("m"), F.col("name").alias("n"), F.col("signature").alias("actual"))
    own = exposes.where(F.col("signature").isNotNull() & ~F.coalesce("kind", F.lit("function")).isin("type", "variable")).join(f, (F.col("module") == F.col("m")) & (F.col("name") == F.col("n"))).where(text.squeeze(F.col("signature")) != text.squeeze(F.col("actual")))
    return finding(own, "signature", _says("declared ", F.col("signature"), ", found ", F.col("actual")), subject="name")


def undeclared_imports(imports: DataFrame, depends_on: DataFrame, external: DataFrame) -> DataFrame:
    """Imports of modules that declare dependencies, in which no declared dependency's name and no external one is contained. All three: module, value. A module's lists become arrays, so each import is tested where it is."""
    deps = depends_on.groupBy(F.col("module").alias("m")).agg(F.collect_set(paths.module_name(F.col("value"))).alias("names"))
    ext = external.groupBy(F.col("module").alias("x")).agg(F.collect_set("value").alias("outside"))
    own = imports.join(deps, F.col("module") == F.col("m")).join(ext, F.col("module") == F.col("x"), "left")
    inside = lambda a: F.coalesce(F.exists(a, lambda n: F.col("value").contains(n)), F.lit(False))
    free = F.col("value").rlike("^(std|core|alloc)::")
    return finding(own.where(~inside("names") & ~inside("outside") & ~free), "undeclared-import", _says("import '", F.col("value"), "' is not declared"), subject="value", kind="dependency", severity="warning")


def forbidden_imports(imports: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Every pair of an import and a forbidden text contained in it, of one module."""
    f = forbidden.select(F.col("module").alias("m"), F.col("value").alias("banned"))
    own = imports.join(f, (F.col("module") == F.col("m")) & F.col("value").contains(F.col("banned")))
    return finding(own, "forbidden-import", _says("import '", F.col("value"), "' contains forbidden '", F.col("banned"), "'"), subject="value", kind="dependency")


def names_diff(declared: DataFrame, actual: DataFrame, what: str, kind: str) -> DataFrame:
    """Declared names missing from the source (errors) and names in the source that a module with any declaration does not declare (warnings). Both: module, value."""
    gone = _anti(declared, actual, {"module": "module", "value": "value"})
    extra = _anti(actual, declared, {"module": "module", "value": "value"}).join(declared.select(F.col("module").alias("m")).distinct(), F.col("module") == F.col("m"), "left_semi")
    return union(finding(gone, f"{what}-missing", _says(f"{what} '", F.col("value"), "' is not in the source"), subject="value", kind=kind), finding(extra, f"{what}-undeclared", _says(f"{what} '", F.col("value"), "' is not declared"), subject="value", kind=kind, severity="warning"))


def orphan_state(uses: DataFrame, owns: DataFrame) -> DataFrame:
    """State read or modified (module, value) that no other module owns."""
    o = owns.select(F.col("module").alias("m"), F.col("value").alias("v"))
    return finding(uses.join(o, (F.col("value") == F.col("v")) & (F.col("module") != F.col("m")), "left_anti"), "orphan-state", _says("no other module owns '", F.col("value"), "'"), subject="value", severity="warning")


def ownership_conflicts(owns: DataFrame) -> DataFrame:
    """State that two modules own, from either side. owns: module, value."""
    o = owns.select(F.col("module").alias("other"), F.col("value").alias("v"))
    return finding(owns.join(o, (F.col("value") == F.col("v")) & (F.col("module") != F.col("other"))), "ownership", _says("'", F.col("value"), "' is also owned by '", F.col("other"), "'"), subject="value")


def ownership_by_claims(owns: DataFrame) -> DataFrame:
    """value and number of owners of state with more than one: exactly where the claims cannot all hold."""
    return owns.distinct().groupBy("value").agg(F.count("*").alias("owners")).where("owners > 1")


def stale_specs(specs: DataFrame) -> DataFrame:
    """Specs whose stored hash is not that of their source. specs: module, source_text, source_hash."""
    now = paths.source_hash(F.col("source_text"))
    return finding(specs.where(F.col("source_hash").isNotNull() & (F.col("source_hash") != now)), "stale", _says("stored hash ", F.col("source_hash"), ", source has ", now), subject="module", severity="warning")


def find_source(specs: DataFrame, files: DataFrame, key: str = "module") -> DataFrame:
    """module and path of its source: the explicit path if it exists (else none), or the first existing candidate of its language. specs: module, language, source_path; files: path."""
    m, low = F.col("module"), F.lower("module")
    fill = lambda c: F.lit(c) if "{" not in c else F.concat(F.lit(c.split("{")[0]), low if "{l}" in c else m, F.lit(c.split("}")[1]))
    places = F.array().cast("array<string>")
    for language, candidates in paths.CANDIDATES.items():
        places = F.when(F.col("language") == language, F.array(*[fill(c) for c in candidates])).otherwise(places)
    tried = specs.select(key, F.posexplode(F.when(F.col("source_path").isNotNull(), F.array("source_path")).otherwise(places)).alias("pos", "candidate"))
    there = files.select(F.col("path").alias("f")).distinct()
    return tried.join(there, F.col("candidate") == F.col("f"), "left_semi").groupBy(key).agg(F.min_by("candidate", "pos").alias("path"))


def resolved_deps(deps: DataFrame, modules: DataFrame, key: str = "module") -> DataFrame:
    """module, value and resolved: the module at that path, else the one of that name, null if neither; modules are given by the column `key`. Of modules with one path or name the last (spec_ordinal) counts."""
    last = lambda by, name: modules.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"k_{name}")).agg(F.max_by(key, "spec_ordinal").alias(name))
    by_path, by_name = last("source_path", "at_path"), last("module", "by_name")
    out = deps.join(by_path, F.col("value") == F.col("k_at_path"), "left").join(by_name, paths.module_name(F.col("value")) == F.col("k_by_name"), "left")
    return out.select("module", "value", F.coalesce("at_path", "by_name").alias("resolved"))


def emitters(emits: DataFrame) -> DataFrame:
    """event and the sorted modules that emit it. emits: module, value."""
    return emits.groupBy(F.col("value").alias("event")).agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))


def event_composition(subscribes: DataFrame, emits: DataFrame) -> DataFrame:
    """Subscriptions that no module emits (errors); emitted events without subscriber (warnings), if anyone subscribes."""
    lost = _anti(subscribes, emits, {"value": "value"})
    unheard = _anti(emits, subscribes, {"value": "value"}).join(subscribes.select(F.lit(1).alias("any")).limit(1), F.lit(True), "left_semi")
    return union(finding(lost, "no-emitter", _says("nothing emits '", F.col("value"), "'"), subject="value", kind="event"), finding(unheard, "no-subscriber", _says("nothing subscribes to '", F.col("value"), "'"), subject="value", kind="event", severity="warning"))


def contract_gaps(requires: DataFrame, ensures: DataFrame) -> DataFrame:
    """Requirements that name a provider's entity of which no ensures text has one of their words of over three bytes. requires: module, name, provider, requirement; ensures: provider, entity, texts (array)."""
    e = ensures.select(F.col("provider").alias("p"), "entity", "texts").where(F.size("texts") > 0)
    near = requires.join(e, (F.col("provider") == F.col("p")) & F.col("requirement").contains(F.col("entity")))
    met = F.exists(text.long_words(F.col("requirement")), lambda w: F.exists("texts", lambda t: t.contains(w)))
    return finding(near.where(~met), "contract", _says("'", F.col("requirement"), "' is not ensured by '", F.col("entity"), "'"), subject="name", severity="warning")


def protocol_events(subscriptions: DataFrame, emits: DataFrame, transitions: DataFrame) -> DataFrame:
    """Subscribed events that the provider emits though they are no call of its protocol, if it has one. subscriptions: module, provider, value; emits: module, value; transitions: module, call."""
    e = emits.select(F.col("module").alias("p"), F.col("value").alias("v")).distinct()
    any_ = transitions.select(F.col("module").alias("q")).distinct()
    calls = transitions.select(F.col("module").alias("r"), F.col("call").alias("c")).distinct()
    own = subscriptions.join(e, (F.col("provider") == F.col("p")) & (F.col("value") == F.col("v")), "left_semi").join(any_, F.col("provider") == F.col("q"), "left_semi")
    return finding(own.join(calls, (F.col("provider") == F.col("r")) & (F.col("value") == F.col("c")), "left_anti"), "event-not-in-protocol", _says("'", F.col("value"), "' is no transition of '", F.col("provider"), "'"), subject="value", kind="protocol", severity="warning")


def split_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Consumers whose contracts name one half of a provider's balanced pair. texts: module, provider, text; pairs: provider, open_fn, close_fn."""
    p = pairs.select(F.col("provider").alias("p"), "open_fn", "close_fn")
    seen = texts.join(p, F.col("provider") == F.col("p")).groupBy("module", "provider", "open_fn", "close_fn").agg(F.bool_or(F.col("text").contains(F.col("open_fn"))).alias("o"), F.bool_or(F.col("text").contains(F.col("close_fn"))).alias("c")).where("o <> c")
    return finding(seen, F.when(F.col("o"), "leak").otherwise("use-before-open"), F.when(F.col("o"), _says("'", F.col("open_fn"), "' without '", F.col("close_fn"), "'")).otherwise(_says("'", F.col("close_fn"), "' without '", F.col("open_fn"), "'")), subject="provider", kind="protocol", severity="warning")


def is_public(refs: DataFrame, modules: DataFrame, explicit: DataFrame, members: DataFrame) -> DataFrame:
    """project, module and is_public: by the project's explicit list, else by its subsystems' members, else true. refs: project, module; modules: project, module, source_path; explicit, members: project, value (path or name)."""
    with_name = refs.join(modules.select(F.col("project").alias("mp"), F.col("module").alias("mm"), "source_path"), (F.col("project") == F.col("mp")) & (F.col("module") == F.col("mm")), "left")

    def listed(df: DataFrame, table: DataFrame, name: str) -> DataFrame:
        per = table.groupBy(F.col("project").alias(f"{name}_p")).agg(F.collect_set("value").alias(name))
        return df.join(per, F.col("project") == F.col(f"{name}_p"), "left")

    both = listed(listed(with_name, explicit, "own"), members, "parts")
    inside = lambda a: F.array_contains(a, F.col("module")) | F.coalesce(F.array_contains(a, F.col("source_path")), F.lit(False))
    return both.select("project", "module", F.when(F.col("own").isNotNull(), inside("own")).when(F.col("parts").isNotNull(), inside("parts")).otherwise(F.lit(True)).alias("is_public"))


def boundaries(refs: DataFrame, projects: DataFrame, modules: DataFrame, public: DataFrame) -> DataFrame:
    """Cross-project references that fail, each with the first step that does: its project has errors, is unknown, has no such module, or keeps it private. A module is found under its path or its name, both whole, else under the reference up to its first dot. refs: module, value (`project::module`); projects: project, errors; modules: project, module, source_path; public: project, module."""
    local = paths.ref_module(F.col("value"))
    r = refs.where(F.col("value").contains("::")).select("module", "value", paths.ref_project(F.col("value")).alias("tp"), local.alias("whole"), F.substring_index(local, ".", 1).alias("part"))
    p = projects.select(F.col("project").alias("p"), "errors")
    keys = modules.select("project", "module", F.explode(F.array_compact(F.array("source_path", "module"))).alias("key")).groupBy("project", "key").agg(F.max("module").alias("found"))
    side = lambda n: keys.select(F.col("project").alias(f"p_{n}"), F.col("key").alias(f"k_{n}"), F.col("found").alias(f"f_{n}"))
    at = lambda n: (F.col("tp") == F.col(f"p_{n}")) & (F.col(n) == F.col(f"k_{n}"))
    v = public.select(F.col("project").alias("vp"), F.col("module").alias("vm")).distinct()
    named = r.join(p, F.col("tp") == F.col("p"), "left").join(side("whole"), at("whole"), "left").join(side("part"), at("part"), "left").withColumn("mm", F.coalesce("f_whole", "f_part"))
    all_ = named.join(v, (F.col("tp") == F.col("vp")) & (F.col("mm") == F.col("vm")), "left")
    step = F.when(F.col("errors") > 0, "project-has-errors").when(F.col("p").isNull(), "unknown-project").when(F.col("mm").isNull(), "unknown-module").when(F.col("vm").isNull(), "private-module")
    return finding(all_.withColumn("step", step).where("step is not null"), F.col("step"), _says("'", F.col("value"), "': ", F.col("step")), subject="value", kind="architectural")


def subsystem_missing(members: DataFrame, modules: DataFrame) -> DataFrame:
    """Members (module = the subsystem, value) that are the path or the name of no module."""
    known = modules.select(F.explode(F.array_compact(F.array("source_path", "module"))).alias("k")).distinct()
    own = members.join(known, F.col("value") == F.col("k"), "left_anti").withColumn("n", paths.module_name(F.col("value")))
    return finding(own.join(modules.select(F.col("module").alias("k")).distinct(), F.col("n") == F.col("k"), "left_anti"), "member-missing", _says("member '", F.col("value"), "' is no module"), subject="value")


def subsystem_delegation(exposes: DataFrame, members: DataFrame, functions: DataFrame) -> DataFrame:
    """Delegations (module = the subsystem, name, target) of a wrong form, to no member, or to a function that the member has neither as f nor as Module.f. members: module, value (a module's name); functions: module, name."""
    dot = F.instr("target", ".")
    e = exposes.withColumn("tm", F.when(dot > 0, F.substring_index("target", ".", 1))).withColumn("tf", F.when(dot > 0, F.substring(F.col("target"), dot + 1, F.length("target"))))
    m = members.select(F.col("module").alias("sm"), paths.module_name(F.col("value")).alias("sv")).distinct()
    f = functions.select(F.col("module").alias("fm"), F.when(F.col("name").startswith(F.concat("module", F.lit("."))), F.substring(F.col("name"), F.length("module") + 2, F.length("name"))).otherwise(F.col("name")).alias("fn")).distinct()
    all_ = e.join(m, (F.col("module") == F.col("sm")) & (F.col("tm") == F.col("sv")), "left").join(f, (F.col("tm") == F.col("fm")) & (F.col("tf") == F.col("fn")), "left")
    step = F.when(F.col("tm").isNull(), "delegation-form").when(F.col("sv").isNull(), "delegation-not-member").when(F.col("fn").isNull(), "delegation-no-function")
    return finding(all_.withColumn("step", step).where("step is not null"), F.col("step"), _says("'", F.col("name"), "' to '", F.col("target"), "': ", F.col("step")), subject="name")


def subsystem_leaks(members: DataFrame, deps: DataFrame, external: DataFrame) -> DataFrame:
    """Dependencies of members on what is no member and contains no external name of the member's. members: module, value (a module's name); deps, external: module (a member's name), value."""
    m = members.select(F.col("module").alias("subsystem"), paths.module_name(F.col("value")).alias("member")).distinct()
    d = deps.select(F.col("module").alias("dm"), "value", paths.module_name(F.col("value")).alias("dn"))
    x = external.groupBy(F.col("module").alias("xm")).agg(F.collect_set("value").alias("outside"))
    own = m.join(d, F.col("member") == F.col("dm")).join(m.select(F.col("subsystem").alias("s2"), F.col("member").alias("m2")), (F.col("subsystem") == F.col("s2")) & (F.col("dn") == F.col("m2")), "left_anti")
    free = own.join(x, F.col("member") == F.col("xm"), "left").where(~F.coalesce(F.exists("outside", lambda n: F.col("value").contains(n)), F.lit(False)))
    return finding(free, "subsystem-leak", _says("'", F.col("member"), "' depends on '", F.col("value"), "' outside"), module="subsystem", subject="member", kind="dependency", severity="warning")


def subsystem_forbidden(members: DataFrame, deps: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Dependencies of members that contain, or whose name is, a text forbidden to the subsystem."""
    m = members.select(F.col("module").alias("subsystem"), paths.module_name(F.col("value")).alias("member")).distinct()
    d = deps.select(F.col("module").alias("dm"), "value")
    f = forbidden.select(F.col("module").alias("fs"), F.col("value").alias("banned"))
    own = m.join(d, F.col("member") == F.col("dm")).join(f, (F.col("subsystem") == F.col("fs")) & (F.col("value").contains(F.col("banned")) | (paths.module_name(F.col("value")) == F.col("banned"))))
    return finding(own, "subsystem-forbidden", _says("'", F.col("member"), "' depends on '", F.col("value"), "', forbidden by '", F.col("banned"), "'"), module="subsystem", subject="member", kind="dependency")


def spec_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """module, name and side (spec only, both, source only) of every name. Both: module, name."""
    a, b = declared.select("module", "name").distinct().withColumn("x", F.lit(1)), actual.select("module", "name").distinct().withColumn("y", F.lit(1))
    return a.join(b, ["module", "name"], "full_outer").select("module", "name", F.when(F.col("y").isNull(), "spec only").when(F.col("x").isNull(), "source only").otherwise("both").alias("side"))


def dependency_diff(declared: DataFrame, imports: DataFrame, forbidden: DataFrame) -> DataFrame:
    """module, value and state of every dependency: used, unused, forbidden or unknown; forbidden outranks unknown. All: module, value."""
    d = declared.groupBy(F.col("module").alias("dm")).agg(F.collect_set("value").alias("deps"))
    f = forbidden.groupBy(F.col("module").alias("fm")).agg(F.collect_set("value").alias("banned"))
    hit = lambda a: F.coalesce(F.exists(a, lambda n: F.col("value").contains(paths.module_name(n))), F.lit(False))
    seen = imports.join(d, F.col("module") == F.col("dm"), "left").join(f, F.col("module") == F.col("fm"), "left").select("module", "value", F.when(hit("deps"), "used").when(hit("banned"), "forbidden").otherwise("unknown").alias("state"))
    i = imports.groupBy(F.col("module").alias("im")).agg(F.collect_set("value").alias("all"))
    idle = declared.join(i, F.col("module") == F.col("im"), "left").where(~F.coalesce(F.exists("all", lambda x: x.contains(paths.module_name(F.col("value")))), F.lit(False)))
    return seen.unionByName(idle.select("module", "value", F.lit("unused").alias("state")))


def transition_marks(transitions: DataFrame, functions: DataFrame) -> DataFrame:
    """module, pos, from_state, call, to_state and exists: whether the source has a function of the call's name, public or not. transitions: module, pos, from_state, call, to_state; functions: module, name."""
    f = functions.select(F.col("module").alias("fm"), F.col("name").alias("fn")).distinct()
    return transitions.join(f, (F.col("module") == F.col("fm")) & (F.col("call") == F.col("fn")), "left").select("module", "pos", "from_state", "call", "to_state", F.col("fn").isNotNull().alias("exists"))


def apply_enrichment(specs: DataFrame, patch: DataFrame) -> DataFrame:
    """Specs (module, layer, forbidden_deps) with what the patch of their module says: its forbidden dependencies in place of theirs, its layer, in lower case, if it gives one. patch: module, layer, forbidden_deps."""
    p = patch.select(F.col("module").alias("pm"), F.col("layer").alias("new_layer"), F.coalesce("forbidden_deps", F.array().cast("array<string>")).alias("new_deps"))
    joined = specs.join(p, F.col("module") == F.col("pm"), "left")
    return joined.select("module", F.coalesce(F.lower("new_layer"), "layer").alias("layer"), F.when(F.col("pm").isNotNull(), F.col("new_deps")).otherwise(F.col("forbidden_deps")).alias("forbidden_deps"))


def merge_lists(own: DataFrame, patch: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """own with the items of each of the list fields that the patch adds appended; nothing is taken away. Both: keys and fields."""
    p = patch.select(*[F.col(k).alias(f"p_{k}") for k in keys], *[F.col(f).alias(f"p_{f}") for f in fields])
    on = [F.col(k) == F.col(f"p_{k}") for k in keys]
    rest = [c for c in own.columns if c not in fields]
    return own.join(p, on, "left").select(*rest, *[append_missing(f, f"p_{f}").alias(f) for f in fields])


def cached_verdicts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted invariants (with cache_key) and the cached verdict; satisfies is null for those still to verify. cache: cache_key, satisfies."""
    return wanted.join(cache.select(F.col("cache_key").alias("k"), "satisfies"), F.col("cache_key") == F.col("k"), "left").drop("k")


def apply_patch(exposes: DataFrame, patch: DataFrame) -> DataFrame:
    """Exposed entities that the patch names, with its description where it gives one. exposes, patch: module, name, description."""
    p = patch.select(F.col("module").alias("pm"), F.col("name").alias("pn"), F.col("description").alias("new"))
    return exposes.join(p, (F.col("module") == F.col("pm")) & (F.col("name") == F.col("pn"))).select("module", "name", F.coalesce("new", "description").alias("description"))


def append_missing(own: Column | str, more: Column | str) -> Column:
    """own, then what of more it does not hold; own's repetitions stay, those of more don't."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.array().cast("array<string>")) for x in (own, more))
    return F.concat(a, F.filter(F.array_distinct(b), lambda v: ~F.array_contains(a, v)))


def merge_contracts(own: DataFrame, patch: DataFrame) -> DataFrame:
    """module, name and items with the patch's items appended. Both: module, name, items (array)."""
    p = patch.select(F.col("module").alias("pm"), F.col("name").alias("pn"), F.col("items").alias("more"))
    return own.join(p, (F.col("module") == F.col("pm")) & (F.col("name") == F.col("pn")), "left").select("module", "name", append_missing("items", "more").alias("items"))


def dep_context(deps: DataFrame, lines: DataFrame) -> DataFrame:
    """module and the text of its dependencies' lines, in order of pos. deps: module, value, pos; lines: module, line."""
    one = lines.select(F.col("module").alias("lm"), "line")
    return deps.join(one, F.col("value") == F.col("lm")).groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("context"))


def resolve_defaults(dirs: DataFrame, defaults: DataFrame, scalars: tuple[str, ...]) -> DataFrame:
    """dir and the scalars of the deepest of its ancestors, itself included, that sets each. dirs: dir (`a/b/c`); defaults: dir and the scalars."""
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("prefix")))).alias("a")).select("dir", "a.*")
    d = defaults.select(F.col("dir").alias("d"), *scalars)
    return up.join(d, F.col("prefix") == F.col("d"), "left").groupBy("dir").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in scalars])


def apply_defaults(specs: DataFrame, defaults: DataFrame, scalars: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """Specs with unset scalars filled and missing list items appended. specs, defaults: dir, scalars and lists; specs also module."""
    d = defaults.select(F.col("dir").alias("d"), *[F.col(c).alias(f"d_{c}") for c in scalars + lists])
    return specs.join(d, F.col("dir") == F.col("d"), "left").select("module", *[F.coalesce(c, f"d_{c}").alias(c) for c in scalars], *[append_missing(c, f"d_{c}").alias(c) for c in lists])
