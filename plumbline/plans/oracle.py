"""DuckDB SQL of the queries, over the role bindings as common table expressions."""

from __future__ import annotations

from plumbline.operators import protocol
from plumbline.plans import snippets
from plumbline.plans.bind import ctes
from plumbline.sources import scan

ORACLE_SQL: dict[str, str] = {}


def _sql(key: str, roles: str, text: str) -> None:
    ORACLE_SQL[key] = ctes(*roles.split()) + text


#: module, subject, severity, check_id and message in this order, by position
def _f(subject: str, severity: str, check: str, message: str, module: str = "module") -> str:
    return f"{module} as module, {subject} as subject, {severity} as severity, {check} as check_id, {message} as message"


P1 = r"regexp_replace(regexp_replace({0}, '(\.rs)+$', ''), '(/mod)+$', '')"
def _p1(c: str) -> str:
    return f"split_part({P1.format(c)}, '/', -1)"


_EDGE = "from edges e join modules s on e.src = s.module join modules t on e.dst = t.module"
_ALLOWED = "((s.layer = 'domain' and t.layer = 'infrastructure') or (s.layer = 'application' and t.layer in ('domain', 'infrastructure')) or (s.layer = 'presentation' and t.layer in ('application', 'domain', 'infrastructure')))"
_LAYER = f"s.layer is not null and t.layer is not null and s.layer <> t.layer and s.layer <> 'custom' and not {_ALLOWED}"
_CONTEXT = "s.context <> t.context and coalesce(s.layer, '') <> 'presentation' and coalesce(t.layer, '') <> 'presentation'"
_RANK = "case {0}.stability when 'stable' then 0 when 'normal' then 1 when 'volatile' then 2 end"
_STABLE = f"{_RANK.format('s')} < {_RANK.format('t')}"
_RULES = {"layer-direction": (_LAYER, "a layer may only use the layers beneath it"), "context-isolation": (_CONTEXT, "another context is reached through presentation only"), "stability-direction": (_STABLE, "what a module uses must be as stable as itself")}
_ALL_RULES = " union all ".join(f"select e.src, e.dst, '{k}' as rule, 'error' as severity, '''' || e.src || ''' -> ''' || e.dst || ''': {d}' as message {_EDGE} where {c}" for k, (c, d) in _RULES.items())
_sql("rule_violations", "edges modules", _ALL_RULES)
for _k, (_c, _d) in _RULES.items():
    _sql(_k.split("-")[0] + "_violations", "edges modules", f"select e.src, e.dst, 'error' as severity {_EDGE} where {_c}")
ORACLE_SQL["layer_pairs"] = """select lower(a.r_name) as src, lower(b.r_name) as dst, 'linear' as model from region a join region b on b.r_regionkey > a.r_regionkey
    union all select * from (values ('domain', 'infrastructure', 'built-in'), ('application', 'domain', 'built-in'), ('application', 'infrastructure', 'built-in'), ('presentation', 'application', 'built-in'), ('presentation', 'domain', 'built-in'), ('presentation', 'infrastructure', 'built-in')) v(src, dst, model)"""

_sql("module_name", "modules", f"""select path, {_p1('path')} as name from (select case spec_ordinal % 3 when 0 then regexp_replace(source_path, '\\.rs$', '/mod.rs') when 1 then source_path || '.rs' else source_path end as path from modules)""")
_sql("cross_ref", "cross_refs", "select module, value, case when instr(value, '::') > 0 then split_part(value, '::', 1) end as project, case when instr(value, '::') > 0 then substr(value, instr(value, '::') + 2) else value end as target from cross_refs")
_PUBLIC = """pub as (select m.project, m.module, case when m.project in (select project from explicit_public) then exists (select 1 from explicit_public e where e.project = m.project and e.value in (m.module, m.source_path))
    when m.project in (select project from public_members) then exists (select 1 from public_members e where e.project = m.project and e.value in (m.module, m.source_path)) else true end as is_public from project_modules m)"""
ORACLE_SQL["is_public"] = ctes("project_modules", "explicit_public", "public_members").rstrip() + ", " + _PUBLIC + " select * from pub"
_sql("exclude_glob", "modules", r"select module, source_path from modules where not regexp_matches(source_path, '^src/Brand#1[^/]*/.*$') and not regexp_matches(source_path, '^(.*/)?m[^/]\.rs$') and not regexp_matches(source_path, '^src/[^/]*/m[^/]*7\.rs$')")
ORACLE_SQL["source_hash"] = "select doc_id, left(sha256(text), 16) as hash from documents"
ORACLE_SQL["detect_language"] = """select path, case e when '' then null when 'rs' then 'rust' when 'sol' then 'solidity' when 'flow' then 'flow9' when 'tsx' then 'typescript' when 'ts' then 'typescript' when 'js' then 'javascript' else e end as language,
    case e when 'rs' then 'rust' when 'sol' then 'solidity' when 'flow' then 'flow9' end as extractor
    from (select 'src/p' || page_id || ['.rs', '.sol', '.flow', '.tsx', '.js', '.py', '', '.test.ts'][page_id % 8 + 1] as path, ['rs', 'sol', 'flow', 'tsx', 'js', 'py', '', 'ts'][page_id % 8 + 1] as e from pages)"""
_sql("find_source", "modules", """, s as (select upper(module) as module, spec_ordinal n, source_path p from modules),
    files as (select p as path from s where n % 2 = 0 union select 'src/' || lower(module) || '.rs' from s where n % 4 = 0 union select 'src/' || module || '.sol' from s where n % 4 = 1 union select module || '.sol' from s where n % 2 = 1 union select module || '.ts' from s where n % 4 = 2 union select 'src/main.rs'),
    tried as (select module, 0 as k, p as c from s where n % 5 = 0
      union all select module, k, case k when 0 then 'src/' || lower(module) || '.rs' when 1 then 'src/lib.rs' else 'src/main.rs' end from s, range(3) t(k) where n % 5 > 0 and n % 3 = 0
      union all select module, k, case k when 0 then 'contracts/' || module || '.sol' when 1 then 'src/' || module || '.sol' else module || '.sol' end from s, range(3) t(k) where n % 5 > 0 and n % 3 = 1
      union all select module, k, case k when 0 then 'src/' || module || '.ts' else module || '.ts' end from s, range(2) t(k) where n % 5 > 0 and n % 3 = 2)
    select module, arg_min(c, k) as path from tried where c in (select path from files) group by module""".replace(", s as", ", s as", 1))
_sql("stale_specs", "specs", "select module, 'warning' as severity, 'stored hash ' || source_hash || ', source has ' || left(sha256(source_text), 16) as message from specs where source_hash is not null and source_hash <> left(sha256(source_text), 16)")
ORACLE_SQL["sanitize_names"] = r"select c_custkey, regexp_replace(c_name || '-é ' || c_mktsegment, '[^\p{L}\p{N}_]', '_', 'g') as name from customer"

for _key, _kind, _facts in (("missing_types", "type", "x_types"), ("missing_vars", "variable", "x_vars")):
    _sql(_key, f"exposes {_facts}", f"select {_f('name', chr(39) + 'error' + chr(39), chr(39) + _kind + '-missing' + chr(39), chr(39) + _kind + ' ' + chr(39) * 2 + chr(39) + ' || name || ' + chr(39) * 3 + ' is not in the source' + chr(39))} from exposes e where kind = '{_kind}' and not exists (select 1 from {_facts} x where x.module = e.module and x.name = e.name)")
_FUNCTIONS = "fn as (select module, name, bool_or(is_public) as p from x_functions group by 1, 2)"
_MISSING_FN = f"select {_f('e.name', chr(39) + 'error' + chr(39), '''case when fn.p is null then 'function-missing' else 'function-private' end''', '''$$function '$$ || e.name || case when fn.p is null then $$' is not in the source$$ else $$' is private$$ end''', 'e.module')} from exposes e left join fn on fn.module = e.module and fn.name = e.name where coalesce(e.kind, 'function') not in ('type', 'variable') and not coalesce(fn.p, false)"
ORACLE_SQL["missing_functions"] = ctes("exposes", "x_functions").rstrip() + ", " + _FUNCTIONS + " " + _MISSING_FN
_SIGNATURE = f"select {_f('e.name', chr(39) + 'error' + chr(39), chr(39) + 'signature' + chr(39), '''$$declared $$ || e.signature || $$, found $$ || x.signature''', 'e.module')} from exposes e join x_functions x on x.module = e.module and x.name = e.name and x.is_public where coalesce(e.kind, 'function') not in ('type', 'variable') and regexp_replace(e.signature, '\\s', '', 'g') <> regexp_replace(x.signature, '\\s', '', 'g')"
_sql("signature_mismatch", "exposes x_functions", _SIGNATURE)
_sql("undeclared_imports", "imports depends_on external_deps", f"""select i.module, i.value as subject, 'warning' as severity, 'undeclared-import' as check_id, $$import '$$ || i.value || $$' is not declared$$ as message from imports i
    where i.module in (select module from depends_on) and not exists (select 1 from depends_on d where d.module = i.module and contains(i.value, {_p1('d.value')})) and not exists (select 1 from external_deps x where x.module = i.module and contains(i.value, x.value)) and not regexp_matches(i.value, '^(std|core|alloc)::')""")
_sql("forbidden_imports", "imports forbidden_deps", "select i.module, i.value as subject, 'error' as severity, 'forbidden-import' as check_id, $$import '$$ || i.value || $$' contains forbidden '$$ || f.value || $$'$$ as message from imports i join forbidden_deps f on f.module = i.module and contains(i.value, f.value)")
for _key, _declared, _actual, _what in (("events_diff", "declared_events", "actual_events", "event"), ("state_diff", "owns_state", "actual_state", "state")):
    _sql(_key, f"{_declared} {_actual}", f"""select d.module, d.value as subject, 'error' as severity, '{_what}-missing' as check_id, $${_what} '$$ || d.value || $$' is not in the source$$ as message from {_declared} d where not exists (select 1 from {_actual} a where a.module = d.module and a.value = d.value)
        union all select a.module, a.value, 'warning', '{_what}-undeclared', $${_what} '$$ || a.value || $$' is not declared$$ from {_actual} a where a.module in (select module from {_declared}) and not exists (select 1 from {_declared} d where a.module = d.module and a.value = d.value)""")
_ORPHAN = "select r.module, r.value as subject, 'warning' as severity, 'orphan-state' as check_id, $$no other module owns '$$ || r.value || $$'$$ as message from reads_state r where not exists (select 1 from owns_state o where o.value = r.value and o.module <> r.module)"
_OWNERSHIP = "select a.module, a.value as subject, 'error' as severity, 'ownership' as check_id, $$'$$ || a.value || $$' is also owned by '$$ || b.module || $$'$$ as message from owns_state a join owns_state b on a.value = b.value and a.module <> b.module"
_sql("orphan_state", "reads_state owns_state", _ORPHAN)
_sql("ownership_conflicts", "owns_state", _OWNERSHIP)
_sql("ownership_smt", "owns_state", "select value, count(*) as owners from (select distinct * from owns_state) group by value having count(*) > 1")
_sql("spec_diff", "exposes x_functions", """, d as (select distinct module, name from exposes), a as (select distinct module, name from x_functions where is_public)
    select coalesce(d.module, a.module) as module, coalesce(d.name, a.name) as name, case when a.module is null then 'spec only' when d.module is null then 'source only' else 'both' end as side from d full join a on d.module = a.module and d.name = a.name""")

_sql("resolved_deps", "member_deps project_modules", f"select d.module, d.value, coalesce(p.module, n.module) as resolved from member_deps d left join project_modules p on p.source_path = d.value left join project_modules n on n.module = {_p1('d.value')}")
_sql("contract_gaps", "requires ensured", r"""select r.module, r.name as subject, 'warning' as severity, 'contract' as check_id, $$'$$ || r.requirement || $$' is not ensured by '$$ || e.entity || $$'$$ as message
    from requires r join (select distinct provider, entity from ensured) e on e.provider = r.provider and contains(r.requirement, e.entity)
    where not exists (select 1 from ensured t, unnest(regexp_split_to_array(trim(r.requirement), '\s+')) w(w) where t.provider = e.provider and t.entity = e.entity and strlen(w.w) > 3 and contains(t.text, w.w))""")
_sql("protocol_events", "step_subscribes step_emits transitions", """select s.module, s.value as subject, 'warning' as severity, 'event-not-in-protocol' as check_id, $$'$$ || s.value || $$' is no transition of '$$ || s.module || $$'$$ as message from step_subscribes s
    where exists (select 1 from step_emits e where e.module = s.module and e.value = s.value) and s.module in (select module from transitions) and not exists (select 1 from transitions t where t.module = s.module and t.call = 'do_' || s.value)""")
_sql("split_pairs", "call_lines event_pairs", """, t as (select 'v' || string_split(line, '(')[-1] as module, module as provider, line from call_lines),
    g as (select t.module, t.provider, p.open_fn, p.close_fn, bool_or(contains(t.line, p.open_fn)) as o, bool_or(contains(t.line, p.close_fn)) as c from t join event_pairs p on p.module = t.provider group by all)
    select module, provider as subject, 'warning' as severity, case when o then 'leak' else 'use-before-open' end as check_id, case when o then $$'$$ || open_fn || $$' without '$$ || close_fn || $$'$$ else $$'$$ || close_fn || $$' without '$$ || open_fn || $$'$$ end as message from g where o <> c""")
_EVENTS = """select s.module, s.value as subject, 'error' as severity, 'no-emitter' as check_id, $$nothing emits '$$ || s.value || $$'$$ as message from subscribes s where s.value not in (select value from emits)
    union all select e.module, e.value, 'warning', 'no-subscriber', $$nothing subscribes to '$$ || e.value || $$'$$ from emits e where e.value not in (select value from subscribes) and exists (select 1 from subscribes)"""
_sql("event_composition", "subscribes emits", _EVENTS)
_sql("emitters", "emits", "select value as event, string_agg(distinct module, ',' order by module) as modules from emits group by value")
_sql("subsystem_missing", "members project_modules", f"select m.module, m.value as subject, 'error' as severity, 'member-missing' as check_id, $$member '$$ || m.value || $$' is no module$$ as message from members m where m.value not in (select source_path from project_modules union all select module from project_modules) and {_p1('m.value')} not in (select module from project_modules)")
_sql("subsystem_delegation", "delegations members member_functions", f""", d as (select *, case when instr(target, '.') > 0 then split_part(target, '.', 1) end as tm, case when instr(target, '.') > 0 then substr(target, instr(target, '.') + 1) end as tf from delegations),
    x as (select d.*, case when tm is null then 'delegation-form' when not exists (select 1 from members m where m.module = d.module and {_p1('m.value')} = d.tm) then 'delegation-not-member'
      when not exists (select 1 from member_functions f where f.module = d.tm and f.name in (d.tf, d.tm || '.' || d.tf)) then 'delegation-no-function' end as step from d)
    select module, name as subject, 'error' as severity, step as check_id, $$'$$ || name || $$' to '$$ || target || $$': $$ || step as message from x where step is not null""")
_MEMBER = f"mem as (select distinct module as subsystem, {_p1('value')} as member from members)"
_sql("subsystem_leaks", "members member_deps member_external", f""", {_MEMBER} select m.subsystem as module, m.member as subject, 'warning' as severity, 'subsystem-leak' as check_id, $$'$$ || m.member || $$' depends on '$$ || d.value || $$' outside$$ as message
    from mem m join member_deps d on d.module = m.member where not exists (select 1 from mem o where o.subsystem = m.subsystem and o.member = {_p1('d.value')}) and not exists (select 1 from member_external x where x.module = m.member and contains(d.value, x.value))""")
_sql("subsystem_forbidden", "members member_deps member_forbidden", f""", {_MEMBER} select m.subsystem as module, m.member as subject, 'error' as severity, 'subsystem-forbidden' as check_id, $$'$$ || m.member || $$' depends on '$$ || d.value || $$', forbidden by '$$ || f.value || $$'$$ as message
    from mem m join member_deps d on d.module = m.member join member_forbidden f on f.module = m.subsystem and (contains(d.value, f.value) or {_p1('d.value')} = f.value)""")
_sql("boundaries", "cross_refs projects project_modules explicit_public public_members", f""", {_PUBLIC}, r as (select module, value, split_part(value, '::', 1) as tp, substr(value, instr(value, '::') + 2) as ref from cross_refs where contains(value, '::')),
    keys as (select project, source_path as k, module as m from project_modules union select project, module, module from project_modules), q as (select r.*, coalesce(a.m, b.m) as tm from r left join keys a on a.project = r.tp and a.k = r.ref left join keys b on b.project = r.tp and b.k = split_part(r.ref, '.', 1)),
    x as (select q.*, case when exists (select 1 from projects p where p.project = q.tp and p.errors > 0) then 'project-has-errors' when q.tp not in (select project from projects) then 'unknown-project'
      when tm is null then 'unknown-module' when not exists (select 1 from pub where pub.project = q.tp and pub.module = q.tm and is_public) then 'private-module' end as step from q)
    select module, value as subject, 'error' as severity, step as check_id, $$'$$ || value || $$': $$ || step as message from x where step is not null""")

_STATES = "st as (select module, value from protocol_items where field = 'states')"
_sql("protocol_states", "protocols protocol_items transitions", f""", {_STATES}, used as (select module, 'initial' as role, initial as value from protocols union all select module, 'terminal', value from protocol_items where field = 'terminal' union all select module, 'from', from_state from transitions union all select module, 'to', to_state from transitions)
    select module, value as subject, 'error' as severity, 'state-' || role as check_id, role || $$ state '$$ || value || $$' is not declared$$ as message from used u where module in (select module from st) and not exists (select 1 from st where st.module = u.module and st.value = u.value)""")
_sql("protocol_calls", "transitions call_pairs p_functions", """, used as (select module, 'call' as role, call as value from transitions union all select module, 'pair', open_fn from call_pairs union all select module, 'pair', close_fn from call_pairs)
    select module, value as subject, 'error' as severity, 'protocol-' || role as check_id, $$function '$$ || value || $$' is not in the source$$ as message from used u where not exists (select 1 from p_functions f where f.module = u.module and f.name = u.value)""")
_sql("protocol_unreachable", "protocols protocol_items transitions", f""", {_STATES} select module, value as subject, 'warning' as severity, 'unreachable' as check_id, $$nothing leads to '$$ || value || $$'$$ as message from (select distinct * from st) s
    where not exists (select 1 from protocols p where p.module = s.module and p.initial = s.value) and not exists (select 1 from transitions t where t.module = s.module and t.to_state = s.value)""")
_sql("protocol_deadends", "protocol_items transitions", f""", {_STATES} select module, value as subject, 'warning' as severity, 'dead-end' as check_id, $$nothing leaves '$$ || value || $$'$$ as message from (select distinct * from st) s
    where not exists (select 1 from protocol_items p where p.field = 'terminal' and p.module = s.module and p.value = s.value) and not exists (select 1 from transitions t where t.module = s.module and t.from_state = s.value)""")
_CALLS = "count(*) filter (where not starts_with(line, '//') and not starts_with(line, 'fn ') and contains(line, {0} || '('))"
_sql("balanced_pairs", "call_lines event_pairs", f""", n as (select l.module, p.open_fn, p.close_fn, {_CALLS.format('p.open_fn')} as o, {_CALLS.format('p.close_fn')} as c from call_lines l join event_pairs p on p.module = l.module group by all)
    select module, open_fn as subject, 'warning' as severity, case when c = 0 then 'never-closed' when o = 0 then 'never-opened' else 'unbalanced' end as check_id, open_fn || ' ' || o || ', ' || close_fn || ' ' || c as message from n where o <> c""")
_sql("count_calls", "call_lines", "select module, " + ", ".join(_CALLS.format(f"'{n}'") + f"::bigint as {n}" for n in ("signup", "click", "view", "purchase", "error")) + " from call_lines group by module")
_VERBS = str([v for pair in protocol.PAIRS for v in pair])
_PAIRED = f"""p as (select {_VERBS}[2 * i + 1] as o, {_VERBS}[2 * i + 2] as c from range(10) t(i)),
    found as (select a.module, a.name as open_fn, b.name as close_fn from f a join p on a.name = o or ends_with(a.name, '_' || o) join f b on b.module = a.module and b.name = left(a.name, length(a.name) - length(o)) || c)"""
_sql("detect_pairs", "x_functions", f", k as (select distinct module, substr(name, 2)::int as k from x_functions), f as (select distinct module, case when k % 3 = 0 then 'db_' else '' end || {_VERBS}[k % 20 + 1] as name from k), {_PAIRED} select * from found")
_LIFE = str([*protocol.INIT, *protocol.SHUTDOWN, "run", "open", "close"])
_sql("detect_lifecycle", "x_functions", f""", f as (select distinct module, {_LIFE}[substr(name, 2)::int % 12 + 1] as name from x_functions), {_PAIRED},
    n as (select module, list(name) as a from f group by module), u as (select module, list_filter({list(protocol.INIT)}, lambda x: list_contains(a, x))[1] as up, list_filter({list(protocol.SHUTDOWN)}, lambda x: list_contains(a, x))[1] as down from n)
    select module, 'initial' || case when up is null then '' else ',ready' end || case when down is null then '' else ',terminated' end as states, case when down is null then '' else 'terminated' end as terminal,
    concat_ws(',', 'initial ' || up || ' ready', case when up is null then 'initial ' else 'ready ' end || down || ' terminated') as transitions from u where up is not null or module in (select module from found)""")

_PER = f"v as ({_ALL_RULES}), per as (select src, count(*) as e from v group by src)"
_sql("summary_totals", "modules edges", f", {_PER} select count(*) filter (where e is null) as passed, coalesce(sum(e), 0)::bigint as errors, 0::bigint as warnings from modules left join per on src = module")
_sql("verdict", "modules edges subscribes emits", f""", {_PER}, ev as ({_EVENTS}), t as (select count(*) filter (where e is null) as passed, coalesce(sum(e), 0)::bigint + (select count(*) from ev where severity = 'error') as errors, (select count(*) from ev where severity = 'warning') as warnings from modules left join per on src = module)
    select passed, errors, warnings, case when errors > 0 then 'failed' when warnings > 0 then 'passed with warnings' else 'passed' end as verdict, case when errors > 0 then 1 else 0 end as exit_code from t""")
_MISSING = "select e.module, '{0}-missing' as check_id, 'error' as severity from exposes e where kind = '{0}' and not exists (select 1 from {1} x where x.module = e.module and x.name = e.name)"
_sql("findings_all", "exposes x_types x_vars x_functions owns_state reads_state", f""", {_FUNCTIONS}, every as ({_MISSING.format('type', 'x_types')} union all {_MISSING.format('variable', 'x_vars')} union all select module, check_id, severity from ({_MISSING_FN})
    union all select module, check_id, severity from ({_SIGNATURE}) union all select module, check_id, severity from ({_OWNERSHIP}) union all select module, check_id, severity from ({_ORPHAN}))
    select check_id, 'structural' as kind, 'syntactic' as tier, severity, count(*) as n, count(distinct module) as modules from every group by check_id, severity""")
_sql("project_errors", "exposes x_types", f", b as ({_MISSING.format('type', 'x_types')}) select 'r' || n_regionkey as project, count(*) as errors from b join supplier on module = 's' || s_suppkey join nation on s_nationkey = n_nationkey group by 1")

_sql("in_degree", "edges", "select dst as node, count(*) as n from edges group by dst")
_sql("topo_levels", "dag dag_nodes", ", walk(node, level) as (select node, 0 from dag_nodes n where not exists (select 1 from dag where src = n.node) union select d.src, w.level + 1 from walk w join dag d on d.dst = w.node) select node, max(level)::int as level from walk group by node")
_sql("graph_cycles", "cyclic dag_nodes", ", hot as (select substr(dst, 2)::int as k from cyclic where substr(src, 2)::int < substr(dst, 2)::int), start as (select distinct 'm' || (k // 2) as node from hot), reach(a, b) as (select src, dst from cyclic where src in (select node from start) union select r.a, c.dst from reach r join cyclic c on c.src = r.b), back(a, b) as (select node, node from start union select k.a, c.src from back k join cyclic c on c.dst = k.b) select distinct r.b as node from reach r join back k on k.a = r.a and k.b = r.b")
_sql("project_closure", "nation_edges", ", w(start, node, distance) as (select src, dst, 1 from nation_edges union select w.start, e.dst, w.distance + 1 from w join nation_edges e on e.src = w.node where w.distance < 26) select start, node, min(distance)::int as distance from w group by start, node")
_sql("impact", "dag", ", w(module, node, distance) as (select dst, src, 1 from dag union select w.module, d.src, w.distance + 1 from w join dag d on d.dst = w.node) select module, node as dependent, min(distance)::int as distance from w group by module, node")
_sql("dep_tree", "dag dag_nodes", ", w(node, path, depth) as (select node, node, 0 from dag_nodes union all select d.dst, w.path || ' > ' || d.dst, w.depth + 1 from w join dag d on d.src = w.node) select path, depth::int as depth from w")

ORACLE_SQL["estimate_tokens"] = "select doc_id, (strlen(text) // 4 + 100)::bigint as tokens from documents"
ORACLE_SQL["word_scan"] = "select doc_id, " + ", ".join(f"regexp_matches(text, '(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') as has_{w}" for w in ("token", "on", "License")) + " from documents"
ORACLE_SQL["cache_keys"] = "select doc_id, sha256(text || '|never panics') as cache_key from documents"
_TIER = "case when contains({0}, ': requires ') or contains({0}, ': ensures ') then 'behavioral' when regexp_matches(lower({0}), 'never panics|no panic|returns result|returns error|no unwrap|never unwrap|no unsafe|never unsafe') then 'static' else 'behavioral' end"
_sql("classify_invariants", "invariant_texts", f"select invariant, {_TIER.format('invariant')} as tier from invariant_texts")
_STATIC = """case when regexp_matches(lower(invariant), 'never panics|no panic') then not (contains({0}, 'panic!(') or contains({0}, '.unwrap()') or contains({0}, '.expect(')) when regexp_matches(lower(invariant), 'no unwrap|never unwrap') then not contains({0}, '.unwrap()')
    when regexp_matches(lower(invariant), 'no unsafe|never unsafe') then not regexp_matches({0}, '(^|[^A-Za-z0-9_])unsafe($|[^A-Za-z0-9_])') end"""
_RE2 = lambda pattern: pattern.replace("*+", "*").replace("++", "+").replace("?+", "?")
_STRIPPED = lambda c: f"regexp_replace({c}, '(?m){_RE2(scan.STRINGS)}', '\\1\\2\\3', 'g')"
# what is left of each of the lines that the query adds; texts have no test blocks
_ADDED = ["x.unwrap();", "unsafe { }", "", 'let s = "";', "", "}"]
_LINES = r"""array_to_string(list_transform(list_filter(string_split(code, chr(10)), lambda x: not regexp_matches(x, '^\s*//') and not contains(x, '.contains("') and not contains(x, '.contains(&"') and not contains(x, 'lower.contains')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10))"""
_sql("static_checks", "invariants", f"select module, invariant, {_STATIC.format('c')} as satisfied from (select *, {_STRIPPED(_LINES)} || chr(10) || {_ADDED}[length(code) % 6 + 1] as c from invariants)")
_sql("collect_invariants", "exposes", """select module, description as invariant from exposes where kind = 'variable' and description is not null union all select module, name || ': requires ' || description from exposes where description is not null and coalesce(kind, 'function') <> 'type'
    union all select module, name || ': ensures ' || signature from exposes where description is not null and coalesce(kind, 'function') <> 'type'""")
_sql("behavioral_summary", "invariants", f""", r as (select {_TIER.format('invariant')} as tier, {_STATIC.format('c')} as st, case when length(code) % 4 > 0 then length(code) % 4 > 1 end as cached from (select *, code || [' x.unwrap();', ' unsafe {{ }}', ''][length(code) % 3 + 1] as c from invariants)),
    q as (select *, st is not null and tier = 'static' as s from r)
    select count(*) filter (where s and st) as static_passed, count(*) filter (where s and not st) as static_failed, count(*) filter (where not s and cached) as verified, count(*) filter (where not s and not cached) as violated, count(*) filter (where not s and cached is null) as unverified, count(*) as total from q""")
_sql("cache_join", "wanted verdict_cache", "select w.module, w.cache_key, c.satisfies from wanted w left join verdict_cache c on c.cache_key = w.cache_key")

_sql("apply_patch", "exposes", "select module, name, case when substr(name, 2)::int % 2 = 0 then 'new ' || name else description end as description from exposes where substr(name, 2)::int % 3 = 0")
ORACLE_SQL["merge_contracts"] = """with x as (select 's' || l_suppkey as module, 'o' || l_orderkey as name, l_linenumber n, l_partkey p, l_returnflag || l_linenumber as v from lineitem),
    a as (select module, name, list(v order by n, p, v) as own from x where n <= 4 group by 1, 2), b as (select module, name, list(v order by n, p, v) as more from x where n >= 3 group by 1, 2),
    j as (select a.module, a.name, own, coalesce(more, []) as more from a left join b on a.module = b.module and a.name = b.name)
    select module, name, array_to_string(list_concat(own, list_filter(more, lambda v, i: not list_contains(own, v) and list_position(more, v) = i)), ',') as items from j"""
_sql("dep_context", "dag modules", "select e.src as module, string_agg(m.module || ': ' || m.source_path, chr(10) order by substr(e.dst, 2)::int) as context from dag e join modules m on m.module = e.dst group by e.src")
_RESOLVED = """up as (select d.dir, k, array_to_string(string_split(d.dir, '/')[1:k], '/') as prefix from spec_dirs d, range(1, 4) t(k)),
    res as (select up.dir, max_by(f.language, k) filter (where f.language is not null) as language, max_by(f.layer, k) filter (where f.layer is not null) as layer, max_by(f.stability, k) filter (where f.stability is not null) as stability from up left join defaults f on f.dir = up.prefix group by up.dir)"""
_sql("defaults_resolve", "spec_dirs defaults", f", {_RESOLVED} select dir, language, layer, stability from res")
_sql("apply_defaults", "modules spec_dirs defaults", f", {_RESOLVED} select m.module, r.language, coalesce(m.layer, r.layer) as layer, coalesce(m.stability, r.stability) as stability, case when p.p_partkey % 3 = 0 then 'tokio,clap,tokio,serde' else 'serde,clap' end as external from modules m join part p on p.p_partkey = m.spec_ordinal left join res r on r.dir = 'root/' || p.p_brand || '/' || p.p_type")

ORACLE_SQL["import_roots"] = r"""select page_id, case when r in ('crate', 'super', 'self', 'std', 'core', 'alloc') then 'serde' when r = 'serde' then 'serde' else r || ',serde' end as roots from (select page_id, regexp_extract(regexp_replace(regexp_replace(url, '^https?://', ''), '[/.?#=&-]+', '::', 'g'), '^(\w+)', 1) as r from pages)"""
ORACLE_SQL["internal_deps"] = "select doc_id, 'alpha,' || lang || ',' || source || case when contains(text, ' on ') then ',on' else '' end as deps from documents"
ORACLE_SQL["regex_extract"] = """select event_id, 'C' || user_id as name, 'f_' || event_id as functions, case when event_id % 3 = 0 then 'f_' || event_id else '' end as public, 'E_' || event_type as events, 'total' as state_variables, 'onlyOwner' as modifiers from events"""
_sql("skeleton", "x_types x_functions x_vars", """, pub as (select distinct module, name from x_functions where is_public), e as (select module, name, 'type' as kind, 0 as k from x_types join pub using (module, name) union all select module, name, 'function', 1 from pub union all select module, name, 'variable', 2 from x_vars)
    select module, name, arg_min(kind, k) as kind from e group by module, name""")
def _facts(key: str, facts: list[tuple], source: str) -> None:
    """Every row of the source (path, k, l, s) has all facts, filled from it."""
    ORACLE_SQL[key] = f"with src as ({source}) select path, field, pos::int as pos, {snippets.fill_sql('name')} as name, {snippets.fill_sql('detail')} as detail from src cross join (values {snippets.values_sql(facts)}) t(field, pos, name, detail)"


_DOCS = "select 'd' || doc_id as path, doc_id::varchar as k, lang as l, source as s from documents"
_facts("x_rust", snippets.RUST_FACTS, _DOCS)
_facts("x_flow9", snippets.FLOW9_FACTS, _DOCS)
_facts("x_solc", snippets.SOLC_FACTS, "select 'e' || event_id as path, event_id::varchar as k, event_type as l, user_id::varchar as s from events")

ORACLE_SQL["strip_strings"] = r"""with t as (select doc_id, 'let a = "x' || doc_id || '\\\" y"; b \" c "d' || chr(10) || text || chr(10) || '"open // \' as code from documents) select doc_id, """ + _STRIPPED("code") + " as code from t"
ORACLE_SQL["strip_comments"] = r"""with t as (select page_id, html || chr(10) || '"// kept \" /* kept */" // gone' || chr(10) || '/* gone " */ a /* ' || url as code from pages) select page_id, regexp_replace(code, '(?s)""" + _RE2(scan.COMMENTS) + r"""', '\1', 'g') as code from t"""
ORACLE_SQL["strip_tests"] = "select doc_id, 'fn a() { x.unwrap(); }' || chr(10) || ' } }' || chr(10) || text as code from documents"
ORACLE_SQL["greedy_budget"] = """with recursive b as (select 'o' || l_orderkey as module, repeat('x', l_quantity::int) as block, row_number() over (partition by l_orderkey order by l_linenumber % 5, l_partkey, repeat('x', l_quantity::int)) as i from lineitem),
    w(module, i, taken, room, dropped) as (select distinct module, 0::bigint, []::varchar[], 60, 0 from b
        union all select w.module, b.i, case when length(block) + 1 <= room then list_append(taken, block) else taken end, case when length(block) + 1 <= room then room - length(block) - 1 else room end, case when length(block) + 1 <= room then dropped else dropped + 1 end from w join b on b.module = w.module and b.i = w.i + 1)
    select module, array_to_string(arg_max(taken, i), chr(10)) as text, arg_max(dropped, i)::int as dropped from w group by module"""

_FORMULAS = " union all ".join(f"select k, '{f.replace(chr(39), chr(39) * 2)}' as formula, {h} as holds, {e or 'cast(null as varchar)'} as error from p" for f, h, e in snippets.FORMULAS)
_EVALUATED = f"with p as (select p_partkey as k from part), v as (select 'm' || k as module, 'T' || k as name, case when k % 3 = 0 then 'function' else 'type' end as kind, formula, holds, error from ({_FORMULAS}))"
ORACLE_SQL["formula_eval"] = f"{_EVALUATED} select module, name, kind, formula, holds, error from v"
ORACLE_SQL["type_constraints"] = f"""{_EVALUATED} select module, name as subject, 'error' as severity, case when holds is null then 'formula-error' else 'formula-fails' end as check_id,
    chr(39) || formula || case when holds is null then chr(39) || ' cannot be evaluated: ' || error else chr(39) || ' does not hold' end as message from v where holds is null or not holds"""
ORACLE_SQL["type_parse"] = "select p_partkey, 'Map<' || p_type || ', fn(&mut ' || replace(p_brand, '#', '') || ', &str) -> [u8; 32], (Vec<_>, ()), [' || p_type || '<fn() -> ()>]>' as canonical from part"
ORACLE_SQL["formula_logic"] = """with t as (select case when l_linenumber % 3 = 0 then null else l_quantity > 25 end as a, case when l_partkey % 4 = 0 then null else l_discount > 0.05 end as b from lineitem)
    select a, b, case when a is null then null when not a then false else b end as a_and_b, case when a is null then null when a then true else b end as a_or_b, not a as not_a, case when a is null then null when not a then true else b end as a_implies_b, count(*) as n from t group by all"""
ORACLE_SQL["type_matches"] = "select p_partkey, true as m0, p_brand like 'Brand#1%' as m1, p_type = 'SMALL' and p_brand = 'Brand#2' as m2, false as m3 from part"
_sql("bounds_sat", "bounds", "select variable, coalesce(max(lower) <= min(upper), true) as satisfiable from bounds group by variable")
_sql("bounds_implied", "bounds wished_bounds", """, p as (select variable, max(lower) as low, min(upper) as high from bounds group by 1) select c.variable, coalesce(low > high, false) or ((c.lower is null or coalesce(low >= c.lower, false)) and (c.upper is null or coalesce(high <= c.upper, false))) as valid
    from wished_bounds c left join p on p.variable = c.variable""")
_SIDE = "select '{0}' as field, coalesce(a.module, b.module) as module, coalesce(a.value, b.value) as name, case when b.value is null then 'spec only' when a.value is null then 'source only' else 'both' end as side from (select distinct module, value from {1}) a full join (select distinct module, value from {2}) b on a.module = b.module and a.value = b.value"
_sql("list_diff", "owns_state actual_state declared_events actual_events", _SIDE.format("state", "owns_state", "actual_state") + " union all " + _SIDE.format("event", "declared_events", "actual_events"))
_HIT = "exists (select 1 from {0} d where d.module = i.module and contains(i.value, " + _p1("d.value") + "))"
_sql("dependency_diff", "depends_on imports forbidden_deps", f"""select module, value, case when {_HIT.format('depends_on')} then 'used' when {_HIT.format('forbidden_deps')} then 'forbidden' else 'unknown' end as state from imports i
    union all select d.module, d.value, 'unused' from depends_on d where not exists (select 1 from imports i where i.module = d.module and contains(i.value, {_p1('d.value')}))""")
_sql("transition_marks", "transitions p_functions", "select module, pos, from_state, call, to_state, exists (select 1 from p_functions f where f.module = t.module and f.name = t.call) as exists from transitions t")
_sql("apply_enrichment", "modules", """select module, case when spec_ordinal % 3 > 0 and spec_ordinal % 2 = 0 then 'application' else layer end as layer, case when spec_ordinal % 3 = 0 then 'old,' || context when spec_ordinal % 5 > 0 then context || ',new' else '' end as forbidden_deps from modules""")
_sql("merge_refinement", "exposes", """select module, name, concat_ws(',', description, case when substr(name, 2)::int % 3 > 0 then 'a lock' end) as requires, signature || ',' || signature as ensures, case when substr(name, 2)::int % 3 > 0 and substr(name, 2)::int % 2 = 0 then name else '' end as modifies from exposes""")
_sql("description_context", "described described_entities", """, i as (select module, description, unnest(['open: requires a path', 'close: ensures no loss', 'order is kept', 'openly: ensures nothing']) as invariant from described)
    select i.module, i.invariant, concat_ws(chr(10), 'Module `' || i.module || '`: ' || i.description, '`' || e.name || '`: ' || e.description) as context from i left join described_entities e on e.module = i.module and e.description is not null and starts_with(i.invariant, e.name || ': ')""")
_FILE_EDGES = """n as (select path, regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '') as stem, split_part(path, '/', -2) as folder from crate_files),
    names as (select name, max(path) as dst from (select stem as name, path from n union all select folder, path from n where stem = 'mod') q group by name),
    uses as (select path as src, unnest(regexp_extract_all(text, 'crate::(\\w+)', 1)) as name from crate_files), e as (select distinct src, dst from uses join names using (name) where src <> dst)"""
_sql("file_edges", "crate_files", f", {_FILE_EDGES} select src, dst from e")
_sql("file_levels", "crate_files", f", {_FILE_EDGES}, w(node, level) as (select path, 0 from crate_files union select e.src, w.level + 1 from w join e on e.dst = w.node) select node, max(level)::int as level from w group by node")
