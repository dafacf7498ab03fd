"""The fact tables as views over the driver's tables; one SQL text, read by Spark and by DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.graph import grown

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")
#: Tables that views join to larger ones, and the bytes of their files up to which Spark may broadcast them.
SIDES, SMALL = ("supplier", "part"), 2 << 20

#: In an order in which later views read earlier ones only.
VIEWS: dict[str, str] = {
    "cx_files": """
select s_suppkey as id, concat('src/', lower(replace(n_name,' ','_')), '/', lower(replace(s_name,'#','_')), case s_suppkey % 10 when 0 then '.go' when 1 then '.ts' when 2 then '.js' when 3 then '.py' when 4 then '.rs' when 5 then '.c' when 6 then '.cpp' when 7 then '.java' when 8 then '.php' else '.rb' end) as path,
 case s_suppkey % 10 when 0 then 'go' when 1 then 'typescript' when 2 then 'javascript' when 3 then 'python' when 4 then 'rust' when 5 then 'c' when 6 then 'cpp' when 7 then 'java' when 8 then 'php' else 'ruby' end as language,
 md5(s_name) as hash, cast(100 + s_suppkey % 900 as int) as line_count from supplier join nation on n_nationkey = s_nationkey
""",
    "cx_symbols": """
select p_partkey as id, case when p_partkey % 50 = 49 then cast(null as bigint) else p_partkey % (select count(*) from supplier) end as file_id, case when p_type = 'STANDARD' then split_part(p_name,' ',2) else replace(p_name,' ','_') end as name,
 case p_type when 'ECONOMY' then 'function' when 'STANDARD' then 'method' when 'LARGE' then 'struct' when 'MEDIUM' then 'interface' when 'SMALL' then 'variable' else 'constant' end as kind,
 case when p_size % 3 = 0 then 'private' else 'public' end as visibility,
 case p_size % 4 when 0 then '["static"]' when 1 then '["static","async"]' when 2 then '["abstract"]' else '[]' end as modifiers,
 cast((p_partkey * 7) % 900 as int) as start_line, cast(p_size % 8 as int) as start_col, cast((p_partkey * 7) % 900 + p_size as int) as end_line, cast(8 + p_size % 40 as int) as end_col,
 case when p_type = 'STANDARD' then p_partkey - p_partkey % 10 else cast(null as bigint) end as parent_symbol_id from part
 union all
 select 1000000 + s_suppkey, s_suppkey, lower(replace(n_name,' ','_')), case s_suppkey % 3 when 0 then 'package' when 1 then 'module' else 'namespace' end, 'public', '[]', 0, 0, 0, 20, cast(null as bigint) from supplier join nation on n_nationkey = s_nationkey
""",
    "cx_scopes": """
select 1000000 + s_suppkey as id, s_suppkey as file_id, cast(null as bigint) as symbol_id, 'file' as kind, 0 as start_line, 0 as start_col, 1000 as end_line, 0 as end_col, cast(null as bigint) as parent_scope_id from supplier
 union all select id, file_id, id, 'function', start_line, start_col, end_line, end_col, 1000000 + file_id from cx_symbols where kind in ('function','method') and file_id is not null
 union all select 2000000 + id, file_id, cast(null as bigint), 'block', start_line + 1, start_col, end_line, 4, id from cx_symbols where kind in ('function','method') and file_id is not null and end_line - start_line >= 3
""",
    "cx_references": """
select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + cast(l_quantity as bigint) as id, l_suppkey as file_id, case when p_type = 'STANDARD' then split_part(p_name,' ',2) else replace(p_name,' ','_') end as name, cast(l_orderkey % 900 as int) as start_line, cast(l_linenumber * 8 as int) as start_col, cast(l_orderkey % 900 as int) as end_line, cast(l_linenumber * 8 + length(p_name) as int) as end_col,
 case l_linenumber % 3 when 0 then 'call' when 1 then 'field_access' else 'type_annotation' end as context, l_partkey as x_part, l_returnflag as x_flag, l_linenumber as x_line from lineitem join part on p_partkey = l_partkey
""",
    "cx_resolved_references": """
select id, id as reference_id, x_part as target_symbol_id, case x_line % 4 when 0 then 1.0e0 when 1 then 0.9e0 when 2 then 0.8e0 else 0.7e0 end as confidence, case when x_line % 2 = 0 then 'import' else 'direct' end as resolution_kind from cx_references where x_flag = 'R' and x_part % 3 <> 0
""",
    "cx_call_graph": """
select id, caller_symbol_id, callee_symbol_id, file_id, line, col from (select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + cast(l_quantity as bigint) as id, l_partkey as caller_symbol_id, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as callee_symbol_id, l_suppkey as file_id, cast(l_orderkey % 900 as int) as line, cast(l_linenumber * 8 as int) as col, l_linenumber as ln from lineitem) t where callee_symbol_id is not null and ln = 1
""",
    "cx_imports": """
select c_custkey as id, f.s_suppkey as file_id, case cast(floor(c_custkey / 10) as bigint) % 4 when 0 then lower(replace(t.n_name,' ','_')) when 1 then concat('github.com/acme/', lower(replace(t.n_name,' ','_'))) when 2 then case when cast(floor(c_custkey / 10) as bigint) % 8 = 6 then concat('./', lower(replace(g.s_name,'#','_'))) else concat('external/lib', cast(c_custkey % 13 as string)) end else concat('acme/', lower(replace(t.n_name,' ','_')), '/sub') end as source,
 case when cast(floor(c_custkey / 10) as bigint) % 5 = 0 then case when q.p_type = 'STANDARD' then split_part(q.p_name,' ',2) else replace(q.p_name,' ','_') end else cast(null as string) end as imported_name,
 case when cast(floor(c_custkey / 10) as bigint) % 5 = 1 then case when q.p_type = 'STANDARD' then split_part(q.p_name,' ',2) else replace(q.p_name,' ','_') end else cast(null as string) end as local_alias, case cast(floor(c_custkey / 10) as bigint) % 5 when 0 then 'named' when 1 then 'default' when 2 then 'namespace' when 3 then 'wildcard' else 'module' end as kind, 'file' as scope
 from customer join supplier f on f.s_suppkey = c_custkey % (select count(*) from supplier) join nation t on t.n_nationkey = c_nationkey
 join supplier g on g.s_suppkey = (c_custkey * 10 + f.s_suppkey % 10) % (select count(*) from supplier) join part q on q.p_partkey = (c_custkey * 10) % (select count(*) from part) + f.s_suppkey % 10
 where c_nationkey > f.s_nationkey or c_custkey % 37 = 0 or cast(floor(c_custkey / 10) as bigint) % 8 = 6
""",
    "cx_implementations": """
select a.p_partkey * 100000 + b.p_partkey as id, a.p_partkey as type_symbol_id, b.p_partkey as interface_symbol_id, case (a.p_partkey + b.p_partkey) % 3 when 0 then 'implicit' when 1 then 'explicit' else 'structural' end as kind, a.p_partkey % (select count(*) from supplier) as file_id from part a join part b on a.p_brand = b.p_brand and a.p_size % 5 = b.p_size % 5 where a.p_type = 'LARGE' and b.p_type = 'MEDIUM'
""",
    "cx_type_members": """
select p.p_partkey as id, o.p_partkey as symbol_id, case when p.p_size % 4 in (0,3) then split_part(p.p_name,' ',2) else replace(p.p_name,' ','_') end as name,
 case p.p_size % 4 when 0 then 'method' when 3 then 'method' when 1 then 'field' else 'embedded' end as kind, p.p_brand as type_expr, case when p.p_size % 3 = 0 then 'private' else 'public' end as visibility
 from part p join part o on o.p_partkey = p.p_partkey - p.p_partkey % 10 where p.p_partkey % 10 between 1 and 6 and o.p_type in ('LARGE','MEDIUM')
""",
    "cx_function_parameters": """
select id, symbol_id, concat('p', cast(ordinal as string)) as name, ordinal, type_expr, kind = 'method' and ordinal = 0 as is_receiver, is_return, has_default, case when has_default then '0' else '' end as default_expr
 from (select r.id, r.x_part as symbol_id, s.kind, cast(row_number() over (partition by r.x_part order by r.id) - 1 as int) as ordinal, concat('T', cast(r.file_id % 17 as string)) as type_expr, r.x_line = 3 as is_return, r.x_line = 2 as has_default
 from cx_references r join cx_symbols s on s.id = r.x_part where s.kind in ('function','method') and r.x_flag = 'N' and r.x_line <= 3) t where ordinal < 6
""",
    "cx_type_parameters": """
select p_partkey * 2 + o as id, p_partkey as symbol_id, concat('T', cast(o as string)) as name, cast(o as int) as ordinal, case p_size % 3 when 0 then 'covariant' when 1 then 'contravariant' else '' end as variance, 'type' as param_kind, p_brand as constraints
 from part cross join (select 0 as o union all select 1 as o) k where p_size % 7 = 0 and p_type in ('ECONOMY','LARGE','MEDIUM')
""",
    "cx_annotations": """
select o_orderkey as id, o_orderkey % (select count(*) from part) as target_symbol_id, lower(o_orderpriority) as name, case when o_orderkey % 15 = 0 then (o_orderkey * 7) % (select count(*) from part) else cast(null as bigint) end as resolved_symbol_id,
 concat('(', o_orderstatus, ')') as arguments, o_orderkey % (select count(*) from supplier) as file_id, cast(o_orderkey % 900 as int) as line, 0 as col from orders where o_orderkey % 5 = 0
""",
    "cx_extension_bindings": """
select m.id as id, m.id as member_symbol_id, p.name as extended_type_expr, p.id as extended_type_symbol_id, case when m.id % 5 = 0 then 'override' else 'method' end as kind, '' as constraints, m.id % 4 = 0 as is_default_impl
 from cx_symbols m join cx_symbols p on p.id = m.parent_symbol_id where m.kind = 'method'
""",
    "cx_type_compositions": """
select id, symbol_id as composite_symbol_id, (id * 7) % (select count(*) from part) - case when id % 2 = 0 then 0 else (id * 7) % (select count(*) from part) % 10 end as component_symbol_id, case when id % 2 = 0 then 'embedding' else 'inheritance' end as composition_kind from cx_type_members where kind = 'embedded'
""",
    "cx_reexports": """
select id, file_id, id % (select count(*) from part) as original_symbol_id, concat('x_', source) as exported_name from cx_imports where kind = 'namespace'
""",
    "cx_symbol_fragments": """
select id * 2 + k.o as id, id as symbol_id, (id + k.o) % (select count(*) from supplier) as file_id, start_line, start_col, end_line, end_col, k.o = 0 as is_primary from cx_symbols cross join (select 0 as o union all select 1 as o) k where file_id is null
""",
}


def needed(sql: str) -> list[str]:
    """Views that sql reads, directly or through others, in the order of VIEWS."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\bcx_\w+", todo.pop())) - found:
            if name in VIEWS:
                found.add(name)
                todo.append(VIEWS[name])
    return [x for x in VIEWS if x in found]


def with_views(sql: str) -> str:
    """sql as one statement that defines the views it reads; a leading WITH is merged."""
    head = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in needed(sql))
    body = sql.strip()
    if not head:
        return body
    recursive = "recursive " if re.match(r"with\s+recursive\b", body, re.I) else ""
    body = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I) if re.match(r"with\b", body, re.I) else None
    return f"with {recursive}{head}, {body}" if body else f"with {head} {sql.strip()}"


class Facts:
    """DataFrames of the fact tables of one directory of driver tables, by short name: facts.symbols, facts.files, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        view = f"cx_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._made:
            for t in TABLES:
                self.table(t).createOrReplaceTempView(t)
            self._made[view] = self.spark.sql(with_views(f"select * from {view}"))
        return self._made[view]

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in SIDES and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
            return grown(rows)
        return rows
