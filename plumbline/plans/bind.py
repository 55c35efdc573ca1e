"""Role bindings: the star-schema test tables seen as specs, facts and graphs.

Each role is one query in SQL that Spark and DuckDB both read. In Spark it is a lazy
DataFrame over the Parquet tables; for the oracle it is a common table expression.
Operators know nothing of the test tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

INVARIANTS = ("it never panics", "No Unwrap anywhere", "no unsafe code", "open: requires a path", "close: ensures no panic", "returns Result", "never unwraps", "total is constant", "NO PANIC on input", "order is kept", "never unsafe", "returns error early")

ROLES: dict[str, str] = {
    # graphs
    "modules": """select concat('m', cast(p_partkey as string)) as module, concat('src/', p_brand, '/m', cast(p_partkey as string), '.rs') as source_path, p_brand as context, 'rust' as language,
        case p_type when 'ECONOMY' then 'infrastructure' when 'SMALL' then 'domain' when 'MEDIUM' then 'application' when 'LARGE' then 'presentation' when 'STANDARD' then 'custom' end as layer,
        case p_size % 4 when 0 then 'stable' when 1 then 'normal' when 2 then 'volatile' end as stability, p_partkey as spec_ordinal from {part}""",
    "edges": "select distinct concat('m', cast(a.l_partkey as string)) as src, concat('m', cast(b.l_partkey as string)) as dst from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1",
    "dag": """select concat('m', cast(p_partkey as string)) as src, concat('m', cast(cast(floor(p_partkey / 2.0) as bigint) as string)) as dst from {part} where p_partkey > 0
        union all select concat('m', cast(p_partkey as string)), concat('m', cast(cast(floor(p_partkey / 3.0) as bigint) as string)) from {part} where p_partkey > 0 and p_partkey % 7 = 0""",
    # the same with a way back for some, so that there are cycles
    "cyclic": """select src, dst from {dag} union all select concat('m', cast(cast(floor(p_partkey / 2.0) as bigint) as string)), concat('m', cast(p_partkey as string)) from {part} where p_partkey > 2 and p_partkey % 40 = 3""",
    "dag_nodes": "select concat('m', cast(p_partkey as string)) as node from {part}",
    # the nations from which a nation orders most
    "nation_pairs": """select a, b, row_number() over (partition by a order by n desc, b) as k from (select c.c_nationkey as a, s.s_nationkey as b, count(*) as n from {customer} c join {orders} o on o.o_custkey = c.c_custkey
        join {lineitem} l on l.l_orderkey = o.o_orderkey join {supplier} s on s.s_suppkey = l.l_suppkey group by c.c_nationkey, s.s_nationkey) q""",
    "nation_edges": "select concat('n', cast(a as string)) as src, concat('n', cast(b as string)) as dst from {nation_pairs} where k <= 2",
    # imports and dependencies
    "imports": "select concat('m', cast(page_id % 40 as string)) as module, url as value from {pages}",
    "depends_on": "select concat('m', cast(k as string)) as module, v as value from (select distinct page_id % 40 as k from {pages}) q cross join (select 'src/blog.rs' as v, 0 as r union all select 'lib/www/mod.rs', 1 union all select 'src/example.com.rs', 2) w where k % 4 <> 0 and k % 3 <> r",
    "external_deps": "select concat('m', cast(k as string)) as module, 'example.org' as value from (select distinct page_id % 40 as k from {pages}) q where k % 5 = 0",
    "forbidden_deps": "select concat('m', cast(k as string)) as module, v as value from (select distinct page_id % 40 as k from {pages}) q cross join (select 'cheap-pills' as v, 1 as r union all select 'utm_source', 2 union all select 'example.net', 3) w where k % r = 0",
    # exposed entities and extracted facts
    "exposes": """select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string)) as name, case l_partkey % 4 when 0 then 'type' when 1 then 'variable' when 2 then 'function' end as kind,
        concat('(a: ', cast(l_suppkey % 3 as string), ' ) -> b') as signature, case when l_partkey % 5 > 0 then concat('entity ', cast(l_partkey as string)) end as description from {lineitem}""",
    "x_functions": """select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string)) as name, l_quantity > 15 as is_public, concat('(a:', cast(l_partkey % 3 as string), ')->b') as signature from {lineitem} where l_discount > 0.03""",
    "x_types": "select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string)) as name from {lineitem} where l_tax > 0.02",
    "x_vars": "select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string)) as name from {lineitem} where l_tax > 0.04",
    # state and events
    # a state is a part in a quantity on a line, so that most have one owner and some several
    "owns_state": "select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string), '_', cast(l_linenumber as string), '_', cast(cast(l_quantity as int) as string)) as value from {lineitem}",
    "actual_state": "select distinct concat('s', cast(l_suppkey as string)) as module, concat('p', cast(l_partkey as string), '_', cast(l_linenumber as string), '_', cast(cast(l_quantity as int) as string)) as value from {lineitem} where l_discount > 0.01",
    "reads_state": "select distinct concat('s', cast(l.l_suppkey as string)) as module, concat('p', cast(l.l_partkey as string), '_', cast(l.l_linenumber as string), '_', cast(cast(l.l_quantity as int) as string)) as value from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey where o.o_orderpriority = '1-URGENT'",
    "emits": "select distinct concat('u', cast(user_id as string)) as module, event_type as value from {events} where value > 20",
    "actual_events": "select distinct concat('u', cast(user_id as string)) as module, event_type as value from {events} where value < 2",
    "declared_events": "select distinct concat('u', cast(user_id as string)) as module, event_type as value from {events} where value > 3 and value < 5 and user_id % 3 > 0",
    "subscribes": "select distinct concat('u', cast(user_id as string)) as module, case when user_id % 5 = 0 then concat(event_type, '_v2') else event_type end as value from {events} where value > 30 and event_type <> 'view'",
    # protocols
    # a protocol for what each user did on each day
    "steps": """select concat('u', cast(user_id as string), '-', cast(cast(ts as date) as string)) as module, user_id, event_type, value,
        row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as k, count(*) over (partition by user_id, cast(ts as date)) as n from {events}""",
    "transitions": """select b.module, cast(b.k as bigint) as pos, a.event_type as from_state, concat('do_', b.event_type) as call, b.event_type as to_state
        from {steps} a join {steps} b on a.module = b.module and b.k = a.k + 1""",
    "protocols": "select module, event_type as initial from {steps} where k = 1",
    "protocol_items": """select distinct module, 'states' as field, event_type as value from {steps} where event_type <> 'error' or user_id % 2 = 0
        union all select module, 'states', 'closed' from {steps} where k = 1 and value > 10
        union all select module, 'terminal', case when user_id % 7 = 0 then 'gone' else event_type end from {steps} where k = n""",
    "p_functions": "select distinct module, concat('do_', event_type) as name from {steps} where value > 12",
    "step_emits": "select distinct module, event_type as value from {steps} where value > 20",
    "step_subscribes": "select distinct module, case when user_id % 5 = 0 then concat(event_type, '_v2') else event_type end as value from {steps} where value > 30 and event_type <> 'view'",
    "call_pairs": "select module, o as open_fn, c as close_fn from (select distinct module from {steps}) q cross join (select 'do_signup' as o, 'do_purchase' as c union all select 'do_click', 'do_view') w",
    "event_pairs": "select module, o as open_fn, c as close_fn from (select distinct concat('u', cast(user_id as string)) as module from {events}) q cross join (select 'signup' as o, 'purchase' as c union all select 'click', 'view') w",
    "call_lines": "select concat('u', cast(user_id as string)) as module, concat(case when event_id % 7 = 0 then '// ' when event_id % 11 = 0 then 'fn ' else '' end, event_type, '(', cast(event_id as string), ');') as line from {events}",
    # contracts
    "requires": """select concat('c', cast(u.conv_id as string)) as module, concat('t', cast(u.turn as string)) as name, concat('c', cast(u.conv_id as string)) as provider, concat('the ', u.text) as requirement from {conversations} u where u.role = 'user'""",
    "ensured": """select concat('c', cast(conv_id as string)) as provider, case turn % 3 when 0 then 'th' when 1 then 'the' else 'on' end as entity, text from {conversations} where role <> 'user'""",
    # projects
    "projects": "select concat('r', cast(r_regionkey as string)) as project, cast(case when r_regionkey = 3 then 2 else 0 end as bigint) as errors from {region} where r_regionkey < 4",
    "project_modules": "select concat('r', cast(n_regionkey as string)) as project, concat('n', cast(n_nationkey as string)) as module, concat('src/n', cast(n_nationkey as string), '.rs') as source_path from {nation} where n_nationkey <> 11",
    "explicit_public": "select concat('r', cast(n_regionkey as string)) as project, concat('n', cast(n_nationkey as string)) as value from {nation} where n_nationkey % 2 = 0 and n_regionkey < 2",
    "public_members": "select concat('r', cast(n_regionkey as string)) as project, concat('src/n', cast(n_nationkey as string), '.rs') as value from {nation} where n_nationkey % 3 = 0 and n_regionkey < 3",
    "cross_refs": """select concat('n', cast(p.a as string)) as module, case when p.b % 9 = 8 then concat('n', cast(p.b as string)) when p.b % 7 = 3 then concat('r', cast(n.n_regionkey as string), '::n', cast(p.b as string), '.f') when p.b % 7 = 5 then concat('r', cast(n.n_regionkey as string), '::other/n', cast(p.b as string), '.rs') else concat('r', cast(n.n_regionkey as string), '::src/n', cast(p.b as string), '.rs') end as value
        from {nation_pairs} p join {nation} n on n.n_nationkey = p.b""",
    # subsystems
    "members": "select concat('r', cast(n_regionkey as string)) as module, case when n_nationkey % 6 = 5 then concat('src/gone', cast(n_nationkey as string), '.rs') when n_nationkey % 2 = 0 then concat('n', cast(n_nationkey as string)) else concat('src/n', cast(n_nationkey as string), '.rs') end as value from {nation}",
    "delegations": """select concat('r', cast(n.n_regionkey as string)) as module, s.s_name as name, case s.s_suppkey % 5 when 0 then 'plain' when 1 then concat('n', cast((s.s_nationkey + 1) % 25 as string), '.f1') else concat('n', cast(s.s_nationkey as string), '.f', cast(s.s_suppkey % 4 as string)) end as target
        from {supplier} s join {nation} n on n.n_nationkey = s.s_nationkey""",
    "member_functions": "select concat('n', cast(n_nationkey as string)) as module, case when n_nationkey % 2 = 0 then concat('n', cast(n_nationkey as string), '.f', f) else concat('f', f) end as name from {nation} cross join (select '1' as f union all select '2') w",
    "member_deps": "select src as module, concat('src/', dst, '.rs') as value from {nation_edges}",
    "member_external": "select concat('n', cast(n_nationkey as string)) as module, 'n7' as value from {nation} where n_nationkey % 4 = 0",
    "member_forbidden": "select concat('r', cast(r_regionkey as string)) as module, concat('n', cast(r_regionkey + 1 as string)) as value from {region}",
    # text
    "specs": "select concat('d', cast(doc_id as string)) as module, text as source_text, case when doc_id % 10 = 0 then 'ffff000011112222' when doc_id % 10 < 9 then left({sha}(text), 16) end as source_hash from {documents}",
    "invariant_texts": " union all ".join(f"select '{x}' as invariant, {i} as i" for i, x in enumerate(INVARIANTS)),
    "invariants": "select concat('d', cast(d.doc_id as string)) as module, t.invariant, d.text as code from {documents} d cross join {invariant_texts} t",
    "wanted": "select concat('d', cast(doc_id as string)) as module, {sha}(concat(text, '|', 'quality')) as cache_key from {documents}",
    "verdict_cache": "select {sha}(concat(d.text, '|', 'quality')) as cache_key, max(l.quality) = 1 as satisfies from {labels} l join {documents} d on d.doc_id = l.doc_id group by d.text",
    "described": "select concat('d', cast(doc_id as string)) as module, case when doc_id % 4 > 0 then concat(lang, ' of ', source) end as description from {documents}",
    "described_entities": "select concat('d', cast(doc_id as string)) as module, e as name, case when doc_id % 3 > 0 then concat(e, ' for ', lang) end as description from {documents} cross join (select 'open' as e union all select 'close' union all select 'op') w",
    "crate_files": "select concat('src/', p_brand, '/', case when p_partkey % 10 = 0 then concat('x', cast(p_partkey as string), '/mod') else concat('f', cast(p_partkey as string)) end, '.rs') as path, concat('use crate::f', cast(cast(floor(p_partkey / 2.0) as bigint) as string), '; let a = crate::x', cast(p_partkey - p_partkey % 10 as string), '::b(crate::f', cast(p_partkey as string), ');') as text from {part}",
    "bounds": "select concat('n', cast(s_nationkey as string)) as variable, case when s_suppkey % 2 = 0 then cast(floor(s_acctbal) as bigint) - 8000 end as lower, case when s_suppkey % 3 > 0 then cast(floor(s_acctbal) as bigint) + 2000 end as upper from {supplier}",
    "wished_bounds": "select concat('n', cast(c_nationkey as string)) as variable, case when c_nationkey % 3 > 0 then cast(min(floor(c_acctbal)) as bigint) end as lower, case when c_nationkey % 4 > 0 then cast(max(floor(c_acctbal)) as bigint) end as upper from {customer} group by c_nationkey",
    # defaults
    "spec_dirs": "select distinct concat('root/', p_brand, '/', p_type) as dir from {part}",
    "defaults": """select 'root' as dir, 'rust' as language, 'domain' as layer, cast(null as string) as stability union all select distinct concat('root/', p_brand), case when length(p_brand) > 7 then 'solidity' end, cast(null as string), 'stable' from {part}
        union all select distinct concat('root/', p_brand, '/', p_type), cast(null as string), case when p_type = 'LARGE' then 'presentation' end, case when p_type = 'PROMO' then 'volatile' end from {part}""",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role, or the table of that name, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ROLES[name].replace("{sha}(text)", "sha2(text, 256)").replace("{sha}(concat(text, '|', 'quality'))", "sha2(concat(text, '|', 'quality'), 256)").replace("{sha}(concat(d.text, '|', 'quality'))", "sha2(concat(d.text, '|', 'quality'), 256)")
    return spark.sql(text, **{u: role(spark, sf_dir, u) for u in set(re.findall(r"\{(\w+)\}", text))})


def ctes(*names: str) -> str:
    """WITH clause for DuckDB of the roles and those they rest on."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in out:
            return
        for u in re.findall(r"\{(\w+)\}", ROLES[name].replace("{sha}", "sha256")):
            add(u)
        out[name] = re.sub(r"\{(\w+)\}", r"\1", ROLES[name].replace("{sha}", "sha256"))

    for n in names:
        add(n)
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in out.items()) + "\n"
