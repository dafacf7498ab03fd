"""Names of the engine's queries, bound to the driver's tables, and the same questions in SQL.

A query is an operator applied to the fact tables (``plans.views``). The SQL is
written independently of the operator and reads the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions.metrics import ref_counts
from factloom.operators import discovery as D
from factloom.operators import graph as G
from factloom.operators import incremental as I
from factloom.operators import links as L
from factloom.operators import position as S
from factloom.operators import resolve as R
from factloom.plans import language_rules
from factloom.plans.views import Facts, with_views

PACK = "('package','module','namespace')"
RC = """rc as (select rr.target_symbol_id as id, count(*) as ref_count, cast(sum(case when r.file_id <> s.file_id then 1 else 0 end) as bigint) as external_ref_count
 from cx_resolved_references rr join cx_references r on r.id = rr.reference_id join cx_symbols s on s.id = rr.target_symbol_id group by rr.target_symbol_id)"""
ROWS = f"""{RC}, sr as (select s.id, s.file_id, s.name, s.kind, s.visibility, s.modifiers, s.start_line, s.start_col, s.end_line, s.end_col, s.parent_symbol_id, coalesce(f.path, '') as file_path,
 coalesce(rc.ref_count, 0) as ref_count, coalesce(rc.external_ref_count, 0) as external_ref_count, coalesce(rc.ref_count, 0) - coalesce(rc.external_ref_count, 0) as internal_ref_count
 from cx_symbols s left join cx_files f on f.id = s.file_id left join rc on rc.id = s.id)"""
PKG = f"""pf as (select file_id, arg_max(name, id) as package from cx_symbols where kind in {PACK} and file_id is not null group by file_id)"""
OPEN = f"""loc as (select distinct s.id from cx_symbols s join cx_scopes c on c.file_id = s.file_id and c.kind = 'function' and s.start_line between c.start_line and c.end_line where s.kind = 'variable'),
 ot as (select id, name, file_id, kind, visibility from cx_symbols where kind not in {PACK} and file_id is not null and id not in (select id from loc))"""
ISC = """isc as (select reference_id, scope_id from (select r.id as reference_id, c.id as scope_id, row_number() over (partition by r.id order by (c.end_line - c.start_line) * 10000 + (c.end_col - c.start_col), c.id) as nth
 from cx_references r join cx_scopes c on c.file_id = r.file_id and (c.start_line < r.start_line or (c.start_line = r.start_line and c.start_col <= r.start_col)) and (c.end_line > r.start_line or (c.end_line = r.start_line and c.end_col >= r.start_col))) t where nth = 1)"""
CHAIN = """chain(start_id, depth, id, parent) as (select id, 0, id, parent_scope_id from cx_scopes union all select c.start_id, c.depth + 1, s.id, s.parent_scope_id from chain c join cx_scopes s on s.id = c.parent)"""
IMP = f"""ip as (select distinct i.file_id, coalesce(i.local_alias, string_split(i.source, '/')[-1]) as alias, string_split(i.source, '/')[-1] as package from cx_imports i where string_split(i.source, '/')[-1] in (select package from pf))"""
#: Candidates of every pass in SQL: reference_id, pass_no, tie1, tie2, target, confidence, kind.
CAND = {
    0: "select r.id as reference_id, 0 as pass_no, 0 as tie1, 0 as tie2, cast(null as bigint) as target, 0.0 as confidence, 'import' as kind from cx_references r where exists (select 1 from ip where ip.file_id = r.file_id and ip.alias = r.name)",
    1: "select r.id, 1, c.depth, s.id, s.id, 1.0, 'direct' from cx_references r join isc on isc.reference_id = r.id join chain c on c.start_id = isc.scope_id join cx_scopes k on k.id = c.id join cx_symbols s on s.file_id = r.file_id and s.name = r.name and s.start_line between k.start_line and k.end_line",
    2: f"select r.id, 2, 0, s.id, s.id, 0.9, 'direct' from cx_references r join cx_symbols s on s.file_id = r.file_id and s.name = r.name where s.kind not in {PACK}",
    3: "select r.id, 3, s.file_id, s.id, s.id, 1.0, 'direct' from cx_references r join pf a on a.file_id = r.file_id join ot s on s.name = r.name and s.file_id <> r.file_id join pf b on b.file_id = s.file_id and b.package = a.package",
    4: "select r.id, 4, s.file_id, s.id, s.id, 1.0, 'import' from cx_references r join (select distinct file_id, package from ip) i on i.file_id = r.file_id join pf b on b.package = i.package join ot s on s.file_id = b.file_id and s.name = r.name and s.file_id <> r.file_id where s.visibility = 'public'",
    5: "select r.id, 5, s.file_id, s.id, s.id, 1.0, 'import' from cx_references r join (select h.file_id, h.start_line, min(h.id) as head, arg_min(ip.package, (h.id, ip.package)) as package from cx_references h join ip on ip.file_id = h.file_id and ip.alias = h.name group by h.file_id, h.start_line) h on h.file_id = r.file_id and h.start_line = r.start_line and h.head <> r.id join pf b on b.package = h.package join ot s on s.file_id = b.file_id and s.name = r.name where s.visibility = 'public'",
    6: "select r.id, 6, m.later, m.symbol_id, m.symbol_id, case when m.later = 0 then 0.8 else 0.7 end, 'direct' from cx_references r join pf a on a.file_id = r.file_id join (select distinct symbol_id, name, case when kind = 'method' then 0 else 1 end as later from cx_type_members) m on m.name = r.name join cx_symbols t on t.id = m.symbol_id and t.kind in ('struct','interface','class','enum') and t.file_id is not null join pf b on b.file_id = t.file_id and b.package = a.package where r.context = 'field_access'",
    7: "select r.id, 7, s.file_id, s.id, s.id, 0.7, 'direct' from cx_references r join ot s on s.name = r.name",
}


def chosen(*passes: int) -> str:
    """SQL of the winning candidates of some passes."""
    head = CAND[0] if 0 in passes else CAND[0].replace("where exists", "where false and exists")
    rows = " union all ".join([head, *(CAND[k] for k in passes if k)])
    return f"with recursive {PKG}, {OPEN}, {ISC}, {CHAIN}, {IMP}, cand as ({rows}), won as (select *, row_number() over (partition by reference_id order by pass_no, tie1, tie2, target) as nth from cand) select reference_id, target as target_symbol_id, cast(confidence as double) as confidence, kind as resolution_kind, pass_no from won where nth = 1 and target is not null"


def path_of(facts: Facts, file_id: int) -> str:
    row = facts.files.filter(F.col("id") == file_id).select("path").first()
    return row.path if row else ""


def prefix_of(facts: Facts, file_id: int) -> str:
    return path_of(facts, file_id).rpartition("/")[0]


def least(rows: DataFrame, column: str):
    """The smallest value of a column, so that a lookup by it finds rows at any scale."""
    return rows.agg(F.min(column)).first()[0]


def lookup(table: str, column: str, drop: tuple[str, ...] = ()):
    """Rows of a table with the smallest value of a column, and the same in SQL."""

    def query(facts: Facts) -> DataFrame:
        rows = getattr(facts, table)
        return L.of(rows, column, least(rows, column)).drop(*drop)

    shown = "*" if not drop else f"* exclude ({', '.join(drop)})"
    return query, f"select {shown} from cx_{table} where {column} = (select min({column}) from cx_{table})"


def first_place(facts: Facts):
    """Path, line and column of the resolved reference with the smallest id."""
    row = facts.references.join(facts.resolved_references.select(F.col("reference_id").alias("id")), "id", "left_semi").agg(F.min_by(F.struct("file_id", "start_line", "start_col"), "id").alias("r")).first().r
    return path_of(facts, row.file_id), row.start_line, row.start_col


FIRST = "first as (select file_id, start_line as l, start_col as c from cx_references where id = (select min(reference_id) from cx_resolved_references))"
AT_FIRST = "({0}.start_line < first.l or ({0}.start_line = first.l and {0}.start_col <= first.c)) and ({0}.end_line > first.l or ({0}.end_line = first.l and {0}.end_col >= first.c))"
#: The start of the smallest-spanned annotated symbol.
BUSY = "busy as (select s.file_id, s.start_line as l, s.start_col as c from cx_symbols s where s.file_id is not null and s.id in (select target_symbol_id from cx_annotations) order by s.end_line - s.start_line, s.end_col - s.start_col, s.id limit 1)"
AT_BUSY = AT_FIRST.format("s").replace("first.", "busy.")


def busy_place(facts: Facts):
    marked = facts.annotations.select(F.col("target_symbol_id").alias("id"))
    row = facts.symbols.filter("file_id is not null").join(marked, "id", "left_semi").orderBy(F.col("end_line") - F.col("start_line"), F.col("end_col") - F.col("start_col"), "id").first()
    return row.file_id, row.start_line, row.start_col


EXTRA = ("x_part", "x_flag", "x_line")
PATH = "(select path from cx_files where id = 3)"
PREFIX = "(select regexp_extract(path, '^(.*/)', 1) from cx_files where id = 3)"
SPAN = "(start_line < {0} or (start_line = {0} and start_col <= {1})) and (end_line > {0} or (end_line = {0} and end_col >= {1}))"
ONE_PACKAGE = f"pk as (select s.id, s.name, regexp_extract(f.path, '^(.*/)', 1) as prefix from cx_symbols s join cx_files f on f.id = s.file_id where s.id = 1000003 and s.kind in {PACK})"
IN_PACKAGE = "infiles as (select f.id from cx_files f, pk where starts_with(f.path, pk.prefix))"
WALK = "b(n, d) as (select 0::bigint, 0 union select cg.{2}_symbol_id, b.d + 1 from b join cx_call_graph cg on cg.{1}_symbol_id = b.n where b.d < {0}), nodes as (select n, min(d) as depth from b group by n)"
EDGES = f"""{PKG}, names as (select distinct package from pf), src as (select distinct source from cx_imports),
 tier as (select source, 1 as tier, 0 as file_id, package from src join names on package = source
 union all select source, 2, 0, package from src join names on package = string_split(source, '/')[-1]
 union all select source, 3, f.id, pf.package from src join cx_files f on ends_with(f.path, '/' || source) join pf on pf.file_id = f.id),
 best as (select source, arg_min(package, (tier, file_id)) as to_package from tier group by source),
 pe as (select pf.package as from_package, best.to_package, count(*) as import_count from cx_imports i join best on best.source = i.source join pf on pf.file_id = i.file_id group by all)"""
#: Two snapshots of documents: the second lacks some files, and some have another content.
OLD_DOCS = "select concat(lang, '/', cast(doc_id as string)) as path, doc_id, text from documents where doc_id % 10 <> 1"
NEW_DOCS = "select concat(lang, '/', cast(doc_id as string)) as path, doc_id, case when doc_id % 7 = 0 then concat(text, '!') else text end as text from documents where doc_id % 10 <> 2"


def snapshots(facts: Facts) -> tuple[DataFrame, DataFrame]:
    facts.table("documents").createOrReplaceTempView("documents")
    return tuple(facts.spark.sql(x).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).select("path", "doc_id", "hash") for x in (OLD_DOCS, NEW_DOCS))


def signatures(facts: Facts, symbols: DataFrame | None = None) -> DataFrame:
    return I.signature_hash(facts.symbols if symbols is None else symbols, facts.type_members, facts.function_parameters, facts.type_parameters)


def diff_sides(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Symbols before and after: some go, some come, some change their visibility."""
    out = []
    for k in (1, 2):
        rows = facts.symbols.filter(F.col("id") % 11 != k)
        rows = rows.withColumn("visibility", F.when(F.lit(k == 2) & (F.col("id") % 13 == 0), F.lit("internal")).otherwise(F.col("visibility")))
        named = rows.select("id", "name", "kind", F.coalesce(F.col("parent_symbol_id"), F.lit(-1)).cast("string").alias("parent"))
        out.append(named.join(signatures(facts, rows), "id"))
    return out[0], out[1]


SIG = """select s.id, sha256(concat('name:', s.name, chr(10), 'kind:', s.kind, chr(10), 'visibility:', s.visibility, chr(10), 'modifiers:', coalesce(list_aggregate(list_sort(cast(json(s.modifiers) as varchar[])), 'string_agg', ','), ''), chr(10), coalesce(m.l, ''), coalesce(p.l, ''), coalesce(t.l, ''))) as signature_hash
 from {0} s left join (select symbol_id, string_agg(line, '' order by line) as l from (select symbol_id, concat('member:', name, ':', kind, ':', coalesce(type_expr, ''), ':', visibility, chr(10)) as line from cx_type_members) group by 1) m on m.symbol_id = s.id
 left join (select symbol_id, string_agg(line, '' order by line) as l from (select symbol_id, concat('param:', name, ':', cast(ordinal as varchar), ':', type_expr, ':', case when is_receiver then 'true' else 'false' end, ':', case when is_return then 'true' else 'false' end, chr(10)) as line from cx_function_parameters) group by 1) p on p.symbol_id = s.id
 left join (select symbol_id, string_agg(line, '' order by line) as l from (select symbol_id, concat('typeparam:', name, ':', cast(ordinal as varchar), ':', variance, ':', param_kind, ':', constraints, chr(10)) as line from cx_type_parameters) group by 1) t on t.symbol_id = s.id"""


def transitive(towards: str, part: int):
    def query(facts: Facts) -> DataFrame:
        nodes, edges = G.transitive(facts, 0, 4, towards)
        if part == 0:
            return nodes.select("id", "name", "file_path", "ref_count", "depth")
        return edges if part == 1 else nodes.agg(F.max("depth").alias("max_depth"))

    return query


def walk_sql(towards: str, part: int) -> str:
    ends = ("callee", "caller") if towards == "callers" else ("caller", "callee")
    head = f"with recursive {ROWS}, {WALK.format(4, *ends)} "
    if part == 0:
        return head + "select sr.id, sr.name, sr.file_path, sr.ref_count, nodes.depth from nodes join sr on sr.id = nodes.n"
    if part == 1:
        return head + "select id, caller_symbol_id, callee_symbol_id, file_id, line, col from cx_call_graph where caller_symbol_id in (select n from nodes) and callee_symbol_id in (select n from nodes)"
    return head + "select max(depth) as max_depth from nodes"


def without_odd_files(facts: Facts) -> DataFrame:
    """Rows left in some tables when the files with odd ids go."""
    columns = {"symbols": "file_id", "imports": "file_id", "scopes": "file_id"}
    left = I.without_files({name: getattr(facts, name) for name in columns}, facts.files.filter("id % 2 = 1").select(F.col("id").alias("file_id")), columns)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def package_part(f: Callable) -> Callable:
    return lambda facts: f(facts, D.package_symbol(facts, symbol_id=1000003))


def order_page(column: str, direction: str, n: int, skip: int) -> str:
    nulls = "nulls first" if direction == "asc" else "nulls last"
    return f"order by {column} {direction} {nulls}, id limit {n} offset {skip}"


#: name: (query over facts, SQL over the views, or None).
CATALOG: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {
    "hotspots": (
        lambda x: D.hotspots(x, 20),
        f"with {RC} select s.id, s.name, s.kind, coalesce(f.path, '') as file_path, rc.ref_count, rc.external_ref_count, (select count(*) from cx_call_graph c where c.callee_symbol_id = s.id) as caller_count, (select count(*) from cx_call_graph c where c.caller_symbol_id = s.id) as callee_count from cx_symbols s join rc on rc.id = s.id left join cx_files f on f.id = s.file_id order by rc.external_ref_count desc, s.id limit 20",
    ),
    "ref_counts": (ref_counts, f"with {RC} select * from rc"),
    "symbol_at": (lambda x: S.symbol_at(x, path_of(x, 3), 725, 10), f"with {ROWS} select * from sr where file_path = {PATH} and {SPAN.format(725, 10)} order by end_line - start_line, end_col - start_col, id limit 1"),
    "symbol_at_batch": (
        S.symbol_at_batch,
        "select reference_id, symbol_id from (select r.id as reference_id, s.id as symbol_id, row_number() over (partition by r.id order by s.end_line - s.start_line, s.end_col - s.start_col, s.id) as nth from cx_references r join cx_symbols s on s.file_id = r.file_id and (s.start_line < r.start_line or (s.start_line = r.start_line and s.start_col <= r.start_col)) and (s.end_line > r.start_line or (s.end_line = r.start_line and s.end_col >= r.start_col))) where nth = 1",
    ),
    "definition_at": (
        lambda x: S.definition_at(x, *first_place(x)),
        f"with {FIRST} select r.id as reference_id, s.id as target_symbol_id, f.path as file_path, s.start_line, s.start_col, s.end_line, s.end_col from first join cx_references r on r.file_id = first.file_id and {AT_FIRST.format('r')} join cx_resolved_references rr on rr.reference_id = r.id join cx_symbols s on s.id = rr.target_symbol_id join cx_files f on f.id = s.file_id",
    ),
    "references_to": (lambda x: L.references_to(x, 10), "select r.id as reference_id, f.path as file_path, r.start_line, r.start_col, r.end_line, r.end_col from cx_resolved_references rr join cx_references r on r.id = rr.reference_id join cx_files f on f.id = r.file_id where rr.target_symbol_id = 10"),
    "implementations": (
        lambda x: L.implementations(x, least(x.implementations, "interface_symbol_id")),
        "select s.id as symbol_id, s.name, i.kind, f.path as file_path, s.start_line, s.start_col, s.end_line, s.end_col from cx_implementations i join cx_symbols s on s.id = i.type_symbol_id join cx_files f on f.id = s.file_id where i.interface_symbol_id = (select min(interface_symbol_id) from cx_implementations)",
    ),
    "implements_interfaces": (
        lambda x: L.implements_interfaces(x, least(x.implementations, "type_symbol_id")),
        "select s.id as symbol_id, s.name, i.kind, f.path as file_path, s.start_line, s.start_col, s.end_line, s.end_col from cx_implementations i join cx_symbols s on s.id = i.interface_symbol_id join cx_files f on f.id = s.file_id where i.type_symbol_id = (select min(type_symbol_id) from cx_implementations)",
    ),
    "callers": (lambda x: L.callers(x, 5), "select * from cx_call_graph where callee_symbol_id = 5"),
    "callees": (lambda x: L.callees(x, 5), "select * from cx_call_graph where caller_symbol_id = 5"),
    "dependencies": (lambda x: L.dependencies(x, 3), "select * from cx_imports where file_id = 3"),
    "dependents": (
        lambda x: L.dependents(x, x.imports.filter("source not like '%/%'").agg(F.max("source")).first()[0].upper()),
        "with t as (select max(source) as s from cx_imports where source not like '%/%') select i.* from cx_imports i, t where i.source = upper(t.s) or ends_with(translate(i.source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/' || t.s)",
    ),
    "symbol_detail": (
        lambda x: S.detail_rows(S.symbol_detail(x, x.symbols)),
        """select symbol_id as id, 'parameters' as part, cast(row_number() over (partition by symbol_id order by ordinal, id) - 1 as int) as ordinal, name from cx_function_parameters
 union all select symbol_id, 'members', cast(row_number() over (partition by symbol_id order by id) - 1 as int), name from cx_type_members
 union all select symbol_id, 'type_parameters', cast(row_number() over (partition by symbol_id order by ordinal, id) - 1 as int), name from cx_type_parameters
 union all select target_symbol_id, 'annotations', cast(row_number() over (partition by target_symbol_id order by id) - 1 as int), name from cx_annotations""",
    ),
    "symbol_detail_at": (
        lambda x: S.detail_rows(S.symbol_detail(x, S.symbol_at(x, *busy_place(x)))),
        f"""with {BUSY}, one as (select s.id from cx_symbols s, busy where s.file_id = busy.file_id and {AT_BUSY} order by s.end_line - s.start_line, s.end_col - s.start_col, s.id limit 1)
 select symbol_id as id, 'parameters' as part, cast(row_number() over (partition by symbol_id order by ordinal, id) - 1 as int) as ordinal, name from cx_function_parameters where symbol_id in (select id from one)
 union all select symbol_id, 'members', cast(row_number() over (partition by symbol_id order by id) - 1 as int), name from cx_type_members where symbol_id in (select id from one)
 union all select symbol_id, 'type_parameters', cast(row_number() over (partition by symbol_id order by ordinal, id) - 1 as int), name from cx_type_parameters where symbol_id in (select id from one)
 union all select target_symbol_id, 'annotations', cast(row_number() over (partition by target_symbol_id order by id) - 1 as int), name from cx_annotations where target_symbol_id in (select id from one)""",
    ),
    "scope_at": (
        lambda x: S.scope_at(x, 3, 725, 10),
        f"with recursive one as (select * from cx_scopes where file_id = 3 and {SPAN.format(725, 10)} order by end_line - start_line, end_col - start_col, id limit 1), chain(depth, id, parent) as (select 0, id, parent_scope_id from one union all select c.depth + 1, s.id, s.parent_scope_id from chain c join cx_scopes s on s.id = c.parent) select c.depth, s.* from chain c join cx_scopes s on s.id = c.id",
    ),
    "symbols_list": (D.symbols, f"with {ROWS} select * from sr"),
    "symbols_by_kind": (lambda x: D.symbols(x, D.SymbolFilter(kinds=("struct", "interface"))), f"with {ROWS} select * from sr where kind in ('struct','interface')"),
    "symbols_by_visibility": (lambda x: D.symbols(x, D.SymbolFilter(visibility="private")), f"with {ROWS} select * from sr where visibility = 'private'"),
    "symbols_by_file": (lambda x: D.symbols(x, D.SymbolFilter(file_id=3)), f"with {ROWS} select * from sr where file_id = 3"),
    "symbol_children": (lambda x: D.symbols(x, D.SymbolFilter(parent_id=20)), f"with {ROWS} select * from sr where parent_symbol_id = 20"),
    "symbols_refcount_range": (lambda x: D.symbols(x, D.SymbolFilter(ref_count_min=5, ref_count_max=10)), f"with {ROWS} select * from sr where ref_count between 5 and 10"),
    "symbols_modifiers": (lambda x: D.symbols(x, D.SymbolFilter(modifiers=("static", "async"))), f"""with {ROWS} select * from sr where modifiers like '%"static"%' and modifiers like '%"async"%'"""),
    "symbols_path_prefix": (
        lambda x: D.symbols(x, D.SymbolFilter(path_prefix=least(x.files, "path").rpartition("/")[0].upper())),
        f"with {ROWS}, d as (select regexp_extract(min(path), '^(.*/)', 1) as p from cx_files) select sr.* from sr, d where starts_with(lower(file_path), lower(d.p))",
    ),
    "symbols_total": (lambda x: D.symbols(x).agg(F.count("*").alias("total")), "select count(*) as total from cx_symbols"),
    "symbols_sorted_refcount": (lambda x: D.symbol_page(x, sort="ref_count", order="desc", limit=100), f"with {ROWS} select * from sr {order_page('ref_count', 'desc', 100, 0)}"),
    "symbols_page2": (lambda x: D.symbol_page(x, sort="file", limit=50, offset=50), f"with {ROWS} select * from sr {order_page('file_path', 'asc', 50, 50)}"),
    "files_list": (lambda x: D.file_page(x, sort="line_count", order="desc", limit=1000), f"select * from cx_files {order_page('line_count', 'desc', 500, 0)}"),
    "files_by_language": (lambda x: D.files(x, language="python"), "select * from cx_files where language = 'python'"),
    "packages": (D.packages, f"with {ROWS} select * from sr where kind in {PACK}"),
    "search_prefix": (lambda x: D.search(x, "LARGE*"), f"with {ROWS} select * from sr where name ilike 'large%'"),
    "search_suffix": (
        lambda x: D.search(x, "*" + least(x.symbols, "name")[-3:]),
        f"with {ROWS}, t as (select lower(right(min(name), 3)) as e from cx_symbols) select sr.* from sr, t where ends_with(lower(name), t.e)",
    ),
    "search_infix": (lambda x: D.search(x, "*_a*"), f"with {ROWS} select * from sr where name ilike '%!_a%' escape '!'"),
    "summary_languages": (
        D.language_stats,
        "select f.language, count(distinct f.id) as file_count, (select cast(coalesce(sum(g.line_count), 0) as bigint) from cx_files g where g.language = f.language) as line_count, count(s.id) as symbol_count from cx_files f left join cx_symbols s on s.file_id = f.id group by f.language",
    ),
    "summary_kinds": (D.kinds_by_language, "select f.language, s.kind, count(*) as symbol_count from cx_symbols s join cx_files f on f.id = s.file_id group by all"),
    "summary_package_count": (D.package_count, f"select count(*) as package_count from cx_symbols where kind in {PACK}"),
    "summary_top_symbols": (lambda x: D.top_symbols(x, 15), f"with {ROWS} select * from sr where ref_count > 0 order by external_ref_count desc, id limit 15"),
    "package_summary_exported": (package_part(D.package_exported), f"with {ONE_PACKAGE}, {IN_PACKAGE}, {ROWS} select * from sr where visibility = 'public' and kind not in {PACK} and file_id in (select id from infiles)"),
    "package_summary_kinds": (package_part(D.package_kinds), f"with {ONE_PACKAGE}, {IN_PACKAGE} select kind, count(*) as symbol_count from cx_symbols where file_id in (select id from infiles) group by kind"),
    "package_summary_deps": (package_part(D.package_dependencies), f"with {ONE_PACKAGE}, {IN_PACKAGE} select distinct source from cx_imports where file_id in (select id from infiles)"),
    "package_summary_dependents": (
        package_part(D.package_dependents),
        f"with {ONE_PACKAGE} select distinct f.path from cx_imports i join cx_files f on f.id = i.file_id, pk where (i.source = pk.name or ends_with(lower(i.source), '/' || lower(pk.name))) and not starts_with(f.path, pk.prefix)",
    ),
    "package_summary_file_count": (package_part(lambda x, p: D.package_files(x, p).agg(F.count("*").alias("file_count"))), f"with {ONE_PACKAGE}, {IN_PACKAGE} select count(*) as file_count from infiles"),
    **{f"transitive_{t}_{name}": (transitive(t, k), walk_sql(t, k)) for t in ("callers", "callees") for k, name in enumerate(("nodes", "edges", "depth"))},
    "unused_symbols": (
        D.unused,
        f"select s.id, s.file_id, s.name, s.kind, s.visibility, s.modifiers, s.start_line, s.start_col, s.end_line, s.end_col, s.parent_symbol_id, coalesce(f.path, '') as file_path, cast(0 as bigint) as ref_count, cast(0 as bigint) as external_ref_count, cast(0 as bigint) as internal_ref_count from cx_symbols s left join cx_files f on f.id = s.file_id where s.kind not in {PACK} and not exists (select 1 from cx_resolved_references rr where rr.target_symbol_id = s.id)",
    ),
    "type_hierarchy": (
        lambda x: L.type_hierarchy(x, 10),
        """select t.relation, t.relation_kind, s.id, s.name, s.kind from (select 'implements' as relation, kind as relation_kind, interface_symbol_id as id from cx_implementations where type_symbol_id = 10
 union all select 'implemented_by', kind, type_symbol_id from cx_implementations where interface_symbol_id = 10 union all select 'composes', composition_kind, component_symbol_id from cx_type_compositions where composite_symbol_id = 10
 union all select 'composed_by', composition_kind, composite_symbol_id from cx_type_compositions where component_symbol_id = 10 union all select 'extension', kind, member_symbol_id from cx_extension_bindings where extended_type_symbol_id = 10) t join cx_symbols s on s.id = t.id""",
    ),
    "extension_methods": (lambda x: L.of(x.extension_bindings, "extended_type_symbol_id", 10), "select * from cx_extension_bindings where extended_type_symbol_id = 10"),
    "reexports": lookup("reexports", "file_id"),
    "package_graph_nodes": (G.package_nodes, f"with {PKG} select pf.package, count(*) as file_count, cast(sum(f.line_count) as bigint) as line_count from pf join cx_files f on f.id = pf.file_id group by pf.package"),
    "package_graph_edges": (G.package_edges, f"with {EDGES} select * from pe"),
    "circular_deps": (
        lambda x: G.cycles(G.package_edges(x)),
        f"with recursive {EDGES}, reach(a, b) as (select from_package, to_package from pe union select r.a, e.to_package from reach r join pe e on e.from_package = r.b), part as (select x.a, list_sort(list(distinct x.b)) as members from reach x join reach y on x.a = y.b and x.b = y.a group by x.a) select distinct array_to_string(members, '>') || '>' || members[1] as cycle, cast(len(members) as bigint) as size from part",
    ),
    "impl_pairs": (L.impl_pairs, "select i.id, a.name as type_name, b.name as interface_name, i.kind from cx_implementations i join cx_symbols a on a.id = i.type_symbol_id join cx_symbols b on b.id = i.interface_symbol_id"),
    "call_pairs": (L.call_pairs, "select c.id, a.name as caller_name, b.name as callee_name, c.line, c.col from cx_call_graph c join cx_symbols a on a.id = c.caller_symbol_id join cx_symbols b on b.id = c.callee_symbol_id"),
    "call_degree": (L.call_degree, "select id, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from (select caller_symbol_id as id, 0 as i, 1 as o from cx_call_graph union all select callee_symbol_id, 1, 0 from cx_call_graph) group by id"),
    "package_files": (G.package_of_file, f"with {PKG} select * from pf"),
    "innermost_scope": (S.innermost_scope, f"with {ISC} select * from isc"),
    "resolve_scope": (lambda x: R.resolved(R.winners(R.by_scope(x))), chosen(1)),
    "resolve_first_match": (lambda x: R.resolved(R.winners(R.by_file(x))), chosen(2)),
    "resolve_same_package": (lambda x: R.resolved(R.winners(R.by_package(x))), chosen(3)),
    "resolve_import": (lambda x: R.resolved(R.winners(R.aliases(x), R.by_import(x))), chosen(0, 4)),
    "resolve_qualified": (lambda x: R.resolved(R.winners(R.by_qualifier(x))), chosen(5)),
    "resolve_member": (lambda x: R.resolved(R.winners(R.by_member(x))), chosen(6)),
    "resolve_wildcard": (lambda x: R.resolved(R.winners(R.by_name(x))), chosen(7)),
    "resolve_all": (R.resolve_all, chosen(*range(8))),
    "call_edges": (
        R.call_edges,
        f"with recursive {ISC}, {CHAIN}, c as (select rr.reference_id, rr.target_symbol_id, k.symbol_id as caller, row_number() over (partition by rr.reference_id, rr.target_symbol_id order by ch.depth, k.symbol_id) as nth from cx_resolved_references rr join cx_references r on r.id = rr.reference_id join cx_symbols t on t.id = rr.target_symbol_id join isc on isc.reference_id = r.id join chain ch on ch.start_id = isc.scope_id join cx_scopes k on k.id = ch.id and k.kind = 'function' join cx_symbols o on o.id = k.symbol_id and o.kind in ('function','method') where r.context = 'call' or (r.context = 'field_access' and t.kind in ('function','method'))) select reference_id, target_symbol_id as callee_symbol_id, caller as caller_symbol_id from c where nth = 1",
    ),
    "interface_satisfaction": (
        R.interface_satisfaction,
        "with m as (select distinct tm.symbol_id, tm.name, s.kind from cx_type_members tm join cx_symbols s on s.id = tm.symbol_id where tm.kind = 'method'), n as (select symbol_id, count(*) as needed from m where kind = 'interface' group by symbol_id) select t.symbol_id as type_symbol_id, i.symbol_id as interface_symbol_id, n.needed as methods from m t join m i on i.name = t.name and i.kind = 'interface' join n on n.symbol_id = i.symbol_id where t.kind = 'struct' group by t.symbol_id, i.symbol_id, n.needed having count(*) = n.needed",
    ),
    "extension_bindings": (R.extension_bindings, "select m.id as member_symbol_id, p.name as extended_type_expr, p.id as extended_type_symbol_id from cx_symbols m join cx_symbols p on p.id = m.parent_symbol_id where m.kind = 'method'"),
    "distinct_languages": (lambda x: x.files.select("language").distinct(), "select distinct language from cx_files"),
    "language_for_file": (lambda x: x.files.select("path", P.language(F.col("path")).alias("language")), "select path, language from cx_files"),
    "line_count_documents": (lambda x: x.table("documents").select("doc_id", P.line_count(F.col("text")).cast("long").alias("line_count")), "select doc_id, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as line_count from documents"),
    "changed_files": (
        lambda x: I.changed_files(*snapshots(x)).select("path", "doc_id", "hash"),
        f"with o as ({OLD_DOCS}), n as ({NEW_DOCS}) select path, doc_id, sha256(text) as hash from n where not exists (select 1 from o where o.path = n.path and sha256(o.text) = sha256(n.text))",
    ),
    "stale_files": (lambda x: I.stale_files(*snapshots(x), prefix="en/").select("path", "doc_id"), f"with o as ({OLD_DOCS}), n as ({NEW_DOCS}) select path, doc_id from o where path like 'en/%' and path not in (select path from n)"),
    "signature_hash": (signatures, SIG.format("cx_symbols")),
    "symbol_diff": (
        lambda x: I.symbol_diff(*diff_sides(x)),
        f"""with a as (select * from cx_symbols where id % 11 <> 1), b as (select id, file_id, name, kind, case when id % 13 = 0 then 'internal' else visibility end as visibility, modifiers, parent_symbol_id from cx_symbols where id % 11 <> 2),
 ah as ({SIG.format('a')}), bh as ({SIG.format('b')}),
 o as (select a.name, a.kind, cast(coalesce(a.parent_symbol_id, -1) as varchar) as parent, max(signature_hash) as h from a join ah on ah.id = a.id group by all), n as (select b.name, b.kind, cast(coalesce(b.parent_symbol_id, -1) as varchar) as parent, max(signature_hash) as h from b join bh on bh.id = b.id group by all)
 select coalesce(o.name, n.name) as name, coalesce(o.kind, n.kind) as kind, coalesce(o.parent, n.parent) as parent, case when n.h is null then 'removed' when o.h is null then 'added' else 'changed' end as status from o full join n on o.name = n.name and o.kind = n.kind and o.parent = n.parent where o.h is distinct from n.h""",
    ),
    "blast_radius": (
        lambda x: I.blast_radius(x, x.files.filter("id = 3").select(F.col("id").alias("file_id")), x.symbols.filter("file_id = 3 and id % 2 = 1").select("id")),
        f"""select 3::bigint as file_id union select r.file_id from cx_resolved_references rr join cx_references r on r.id = rr.reference_id join cx_symbols s on s.id = rr.target_symbol_id where s.file_id = 3 and s.id % 2 = 1
 union select i.file_id from cx_imports i join cx_symbols s on s.file_id = 3 and s.kind in {PACK} and (i.source = s.name or string_split(i.source, '/')[-1] = s.name)""",
    ),
    "symbols_by_name": lookup("symbols", "name"),
    "references_by_name": lookup("references", "name", EXTRA),
    "references_by_file": lookup("references", "file_id", EXTRA),
    "references_in_scope": (lambda x: S.innermost_scope(x).filter("scope_id = 1000003"), f"with {ISC} select * from isc where scope_id = 1000003"),
    "scopes_by_file": lookup("scopes", "file_id"),
    "scope_chains": (lambda x: S.chains(x).select("start_id", "depth", "id"), f"with recursive {CHAIN} select start_id, depth, id from chain"),
    "type_members": lookup("type_members", "symbol_id"),
    "function_params": lookup("function_parameters", "symbol_id"),
    "type_params": lookup("type_parameters", "symbol_id"),
    "annotations_by_target": lookup("annotations", "target_symbol_id"),
    "symbol_fragments": lookup("symbol_fragments", "symbol_id"),
    "type_compositions": lookup("type_compositions", "composite_symbol_id"),
    "resolved_by_reference": lookup("resolved_references", "reference_id"),
    "resolved_by_target": lookup("resolved_references", "target_symbol_id"),
    "symbol_by_id": lookup("symbols", "id"),
    "file_by_path": lookup("files", "path"),
    "annotations_resolved": lookup("annotations", "resolved_symbol_id"),
    "type_composed_by": lookup("type_compositions", "component_symbol_id"),
    "all_imports": (lambda x: x.imports, "select * from cx_imports"),
    "all_scopes": (lambda x: x.scopes, "select * from cx_scopes"),
    "kind_map": (
        lambda x: x.symbols.groupBy("file_id", "kind").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n"))))).alias("kinds")),
        """select file_id, '{' || string_agg('"' || kind || '":' || n, ',' order by kind) || '}' as kinds from (select file_id, kind, count(*) as n from cx_symbols group by all) group by file_id""",
    ),
    "package_graph_ranked": (
        lambda x: G.ranked(G.package_edges(x)),
        f"with {EDGES} select *, cast(row_number() over (order by import_count desc, from_package, to_package) as int) as nth from pe",
    ),
    "confidences": (
        lambda x: x.resolved_references.filter(F.col("confidence").between(0, 1)).groupBy("confidence").agg(F.count("*").alias("n")),
        "select confidence, count(*) as n from cx_resolved_references where confidence between 0 and 1 group by confidence",
    ),
    "facts_without_files": (
        without_odd_files,
        "select 'symbols' as name, count(*) as n from cx_symbols where file_id is null or file_id % 2 = 0 union all select 'imports', count(*) from cx_imports where file_id % 2 = 0 union all select 'scopes', count(*) from cx_scopes where file_id % 2 = 0",
    ),
    "links_without_targets": (
        lambda x: I.without_links(x.resolved_references, I.gone_symbols(x.symbols, F.expr("file_id % 2 = 1"))),
        "select * from cx_resolved_references where target_symbol_id in (select id from cx_symbols where file_id is null or file_id % 2 = 0)",
    ),
    "annotations_cleared": (
        lambda x: I.cleared_annotations(x.annotations, x.symbols.filter("file_id % 2 = 1")),
        "select a.* replace (case when s.id is null then a.resolved_symbol_id end as resolved_symbol_id) from cx_annotations a left join cx_symbols s on s.id = a.resolved_symbol_id and s.file_id % 2 = 1",
    ),
    "exported_names": (
        lambda x: x.symbols.select("id", P.exported(F.col("name")).alias("exported")),
        "select id, regexp_matches(name, '^[A-Z]') as exported from cx_symbols",
    ),
    "deterministic_ids": (
        lambda x: x.symbols.select(I.deterministic_id("file_id", "kind", "name", "start_line", "start_col").alias("symbol_key"), "id"),
        "select md5(concat_ws('|', coalesce(cast(file_id as varchar), ''), kind, name, cast(start_line as varchar), cast(start_col as varchar))) as symbol_key, id from cx_symbols",
    ),
}


CATALOG |= language_rules.CATALOG


def bound(query: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Facts(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bound(query) for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in CATALOG.items() if sql}
