"""Queries of the rules of single languages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.operators import languages as N
from factloom.operators import resolve as R

PACK = "('package', 'module', 'namespace')"
CLASS = "('class', 'struct', 'trait', 'module')"
CALL = "('function', 'method', 'static_method', 'class_method', 'property', 'constructor')"
STEM = "regexp_replace(string_split({0}, '/')[-1], '(.)\\.[^.]*$', '\\1')"
MODULE = "regexp_replace(regexp_replace({0}, '^\\./', ''), '\\.(tsx?|jsx?|mjs|cjs)$', '')"
BASE = f"""fl as (select id as file_id, language, {STEM.format('path')} as stem from cx_files),
 loc as (select v.id from cx_symbols v where v.kind = 'variable' and exists (select 1 from cx_scopes s where s.kind = 'function' and s.file_id = v.file_id and v.start_line between s.start_line and s.end_line)),
 ot as (select s.id as target, s.name, s.file_id as tf, s.kind, s.visibility, fl.language, fl.stem from cx_symbols s join fl using (file_id) where s.kind not in {PACK} and s.id not in (select id from loc)),
 pub as (select * from ot where visibility = 'public' or visibility is null),
 rf as (select r.id as reference_id, r.file_id, r.name, r.start_line as line, r.context, fl.language from cx_references r join fl using (file_id))"""


def listed(*names: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def best(rows: str, confidence: str, kind: str, pass_no: int, head: str = BASE) -> str:
    """The first of rows (reference_id, tf, target, more) per reference."""
    return f"""with {head}, c as ({rows}), n as (select *, row_number() over (partition by reference_id order by tf, target) as nth from c)
 select reference_id, target as target_symbol_id, cast({confidence} as double) as confidence, '{kind}' as resolution_kind, {pass_no} as pass_no from n where nth = 1"""


def won(rule):
    return lambda x: R.resolved(R.winners(rule(x)))


def named_sql(languages: tuple[str, ...], confidence: float) -> str:
    rows = f"select rf.reference_id, pub.tf, pub.target from rf join cx_imports i on i.file_id = rf.file_id and i.imported_name is not null and rf.name = coalesce(i.local_alias, i.imported_name) join pub on pub.name = i.imported_name and pub.language = rf.language and pub.tf <> rf.file_id where rf.language in {listed(*languages)}"
    return best(rows, str(confidence), "import", 10)


def module_sql(languages: tuple[str, ...], confidence: float) -> str:
    rows = f"select rf.reference_id, pub.tf, pub.target from rf join cx_imports i on i.file_id = rf.file_id join pub on pub.name = rf.name and pub.language = rf.language and pub.stem = {STEM.format(MODULE.format('i.source'))} and pub.tf <> rf.file_id where rf.language in {listed(*languages)}"
    return best(rows, str(confidence), "import", 11)


def kind_sql(languages: tuple[str, ...], contexts: str, kinds: str) -> str:
    every = f"{BASE}, held as (select s.id as target, s.name, s.file_id as tf, fl.language from cx_symbols s join fl using (file_id) where s.kind in {kinds} and (s.visibility = 'public' or s.visibility is null) and s.id not in (select id from loc))"
    rows = f"select rf.reference_id, held.tf, held.target from rf join held on held.name = rf.name and held.language = rf.language and held.tf <> rf.file_id where rf.context in {contexts} and rf.language in {listed(*languages)}"
    return best(rows, "0.8", "direct", 16, every)


INHERIT = f"""own as (select parent_symbol_id as class_id, name, min(id) as method_id from cx_symbols where kind in {CALL} and parent_symbol_id is not null group by all),
 bs as (select composite_symbol_id as class_id, component_symbol_id as base_id, row_number() over (partition by composite_symbol_id order by id) as ordinal from cx_type_compositions where composition_kind = 'inheritance'),
 reach(class_id, place, ord, path) as (select class_id, class_id, cast([] as bigint[]), [class_id] from (select class_id from own union select class_id from bs) union all select r.class_id, bs.base_id, list_append(r.ord, bs.ordinal), list_append(r.path, bs.base_id) from reach r join bs on bs.class_id = r.place where not list_contains(r.path, bs.base_id)),
 cm as (select class_id, name, method_id from (select r.class_id, own.name, own.method_id, row_number() over (partition by r.class_id, own.name order by r.ord, own.method_id) as nth from reach r join own on own.class_id = r.place) where nth = 1)"""
IN_CLASS_LANGUAGES = ("go", "python", "php", "ruby", "java")
IN_CLASS = f"""with recursive {BASE}, {INHERIT}, cl as (select s.id as class_id, s.file_id as tf, s.start_line as low, s.end_line as high, fl.language from cx_symbols s join fl using (file_id) where s.kind in {CLASS}),
 mt as (select cl.*, cm.name, cm.method_id as target from cm join cl using (class_id)), ask as (select * from rf where context in ('call', 'field_access') and language in {listed(*IN_CLASS_LANGUAGES)}),
 c as (select ask.reference_id, 14 as pass_no, case when ask.line between mt.low and mt.high then 0 else 1 end as tie, mt.target from ask join mt on mt.tf = ask.file_id and mt.name = ask.name
  union all select ask.reference_id, 15, mt.tf, mt.target from ask join mt on mt.tf <> ask.file_id and mt.name = ask.name and mt.language = ask.language),
 n as (select *, row_number() over (partition by reference_id order by pass_no, tie, target) as nth from c)
 select reference_id, target as target_symbol_id, cast(case when pass_no = 15 then 0.7 when tie = 0 then 0.9 else 0.8 end as double) as confidence, 'direct' as resolution_kind, pass_no from n where nth = 1"""


def bases_sql(languages: tuple[str, ...], header: int, first_only: bool) -> str:
    named = f"select fl.language, s.name, s.id as target, case when s.kind in ('interface', 'trait') then 'explicit' else 'extends' end as kind, row_number() over (partition by fl.language, s.name order by s.file_id, s.id) as nth from cx_symbols s join fl using (file_id) where s.kind = 'interface' or s.kind in {CLASS}"
    return f"with {BASE}, nm as ({named}) select distinct s.id as type_symbol_id, nm.target as interface_symbol_id, nm.kind from rf join cx_symbols s on s.file_id = rf.file_id and s.kind in {CLASS} and rf.line between s.start_line and s.start_line + {header} join nm on nm.language = rf.language and nm.name = rf.name{' and nm.nth = 1' if first_only else ''} where rf.context = 'type_annotation' and rf.language in {listed(*languages)} and nm.target <> s.id"


def structural_sql(languages: tuple[str, ...], types: str, faces: str, kind: str) -> str:
    return f"""with {BASE}, ms as (select parent_symbol_id as id, name from cx_symbols where kind = 'method' and parent_symbol_id is not null union select symbol_id, name from cx_type_members where kind = 'method'),
 th as (select ms.* from ms join cx_symbols s using (id) join fl using (file_id) where s.kind in {types} and fl.language in {listed(*languages)}), fc as (select ms.* from ms join cx_symbols s using (id) join fl using (file_id) where s.kind in {faces} and fl.language in {listed(*languages)})
 select t.id as type_symbol_id, f.id as interface_symbol_id, '{kind}' as kind from (select distinct id from th) t, (select distinct id from fc) f where t.id <> f.id and not exists (select 1 from fc x where x.id = f.id and x.name not in (select y.name from th y where y.id = t.id))"""


ALL = tuple(sorted(set(P.LANGUAGES.values())))
SCRIPT, C = ("typescript", "javascript"), ("c", "cpp")
CATALOG = {
    "resolve_named_import_python": (won(lambda x: N.named_import(x, ("python", "rust"), 10, 0.9)), named_sql(("python", "rust"), 0.9)),
    "resolve_named_import_script": (won(lambda x: N.named_import(x, (*SCRIPT, "php"), 10, 1.0)), named_sql((*SCRIPT, "php"), 1.0)),
    "resolve_module_import": (won(lambda x: N.module_import(x, (*SCRIPT, *C), 11, 1.0)), module_sql((*SCRIPT, *C), 1.0)),
    "resolve_require_ruby": (won(lambda x: N.module_import(x, ("ruby", "php", "go"), 11, 0.9)), module_sql(("ruby", "php", "go"), 0.9)),
    "resolve_include": (
        won(lambda x: N.included(x, ALL, 10, ("module", "named", "namespace"), P.stem)),
        best(f"select rf.reference_id, ot.tf, ot.target from rf join cx_imports i on i.file_id = rf.file_id and i.kind in ('module', 'named', 'namespace') join cx_files f on {STEM.format('f.path')} = string_split(i.source, '/')[-1] join ot on ot.tf = f.id and ot.name = rf.name and ot.language = rf.language and ot.tf <> rf.file_id", "1.0", "import", 10),
    ),
    "resolve_member_owner": (
        won(lambda x: N.member_owner(x, ALL, 16)),
        best("select rf.reference_id, s.file_id as tf, s.id as target from rf join cx_type_members m on m.name = rf.name join cx_symbols s on s.id = m.symbol_id and s.kind = 'struct' join fl on fl.file_id = s.file_id and fl.language = rf.language where rf.context = 'field_access'", "0.7", "direct", 16),
    ),
    "resolve_default_import": (
        won(lambda x: N.default_import(x, SCRIPT, 12)),
        best(f"select rf.reference_id, pub.tf, pub.target from rf join cx_imports i on i.file_id = rf.file_id and i.kind = 'default' and i.local_alias = rf.name join pub on pub.language = rf.language and pub.stem = {STEM.format(MODULE.format('i.source'))} and pub.tf <> rf.file_id where rf.language in {listed(*SCRIPT)}", "0.8", "import", 12),
    ),
    "resolve_wildcard_python": (
        won(lambda x: N.wildcard(x, ("python",), 13)),
        best("select rf.reference_id, pub.tf, pub.target from rf join pub on pub.name = rf.name and pub.language = rf.language and pub.tf <> rf.file_id where rf.language = 'python' and rf.file_id in (select file_id from cx_imports where kind = 'wildcard')", "0.7", "import", 13),
    ),
    "consumed_imports": (
        lambda x: N.consumed(x, ALL, ("module", "namespace", "default")).select("reference_id").distinct(),
        f"with {BASE} select distinct rf.reference_id from rf join cx_imports i on i.file_id = rf.file_id and i.kind in ('module', 'namespace', 'default') and rf.name = coalesce(i.local_alias, {STEM.format('i.source')})",
    ),
    "inherited_methods": (N.class_methods, f"with recursive {INHERIT} select class_id, name, method_id from cm"),
    "resolve_in_class": (won(lambda x: N.in_class(x, IN_CLASS_LANGUAGES, 14)), IN_CLASS),
    "resolve_by_kind_php_ruby": (won(lambda x: N.of_kind(x, ("php", "ruby"), 16, ("type_annotation", "call"), N.CLASSES, 0.8)), kind_sql(("php", "ruby"), "('type_annotation', 'call')", CLASS)),
    "resolve_by_kind_c": (won(lambda x: N.of_kind(x, C, 16, ("call", "type_annotation"), ("function", *N.CLASSES), 0.8)), kind_sql(C, "('call', 'type_annotation')", f"('function', {CLASS[1:]}")),
    "resolve_by_language": (
        won(N.by_name),
        best("select rf.reference_id, ot.tf, ot.target from rf join ot on ot.name = rf.name and ot.language = rf.language and ot.tf <> rf.file_id", "0.7", "direct", 20),
    ),
    "decorators_resolved": (
        lambda x: N.decorators(x, ("python", "java")).select("id", "resolved_symbol_id"),
        f"with {BASE}, t as (select fl.language, s.name, s.id, row_number() over (partition by fl.language, s.name order by s.file_id, s.id) as nth from cx_symbols s join fl using (file_id) where (s.kind = 'function' or s.kind in {CLASS}) and fl.language in ('python', 'java')) select a.id, coalesce(t.id, a.resolved_symbol_id) as resolved_symbol_id from cx_annotations a left join fl on fl.file_id = a.file_id left join t on t.language = fl.language and t.name = a.name and t.nth = 1",
    ),
    "bases_in_header": (lambda x: N.bases(x, ("java", "php"), 2), bases_sql(("java", "php"), 2, False)),
    "bases_on_line": (lambda x: N.bases(x, ("python", "ruby"), 0), bases_sql(("python", "ruby"), 0, False)),
    "bases_first_match": (lambda x: N.bases(x, ("cpp", "c"), 0, first_only=True), bases_sql(("cpp", "c"), 0, True)),
    "structural_implements": (lambda x: N.structural(x, ALL, ("struct", "class"), ("interface",), "structural"), structural_sql(ALL, "('struct', 'class')", "('interface')", "structural")),
    "trait_implements": (lambda x: N.structural(x, ("rust", "go", "java", "ruby"), ("struct", "enum"), ("interface", "trait"), "explicit"), structural_sql(("rust", "go", "java", "ruby"), "('struct', 'enum')", "('interface', 'trait')", "explicit")),
    "overrides": (
        lambda x: N.overrides(x, ALL),
        f"with recursive {INHERIT} select distinct s.id as member_symbol_id, cm.method_id as overridden_symbol_id from cx_symbols s join cx_type_compositions b on b.composite_symbol_id = s.parent_symbol_id and b.composition_kind = 'inheritance' and b.component_symbol_id <> b.composite_symbol_id join cm on cm.class_id = b.component_symbol_id and cm.name = s.name where s.kind = 'method' and s.file_id is not null and s.id <> cm.method_id",
    ),
    "mixins": (
        lambda x: N.mixins(x, ALL, "mixin"),
        f"with {BASE} select distinct m.symbol_id as type_symbol_id, t.id as interface_symbol_id, 'mixin' as kind from cx_type_members m join cx_symbols o on o.id = m.symbol_id join fl g on g.file_id = o.file_id join cx_symbols t on t.name = m.name and (t.kind = 'interface' or t.kind in {CLASS}) join fl h on h.file_id = t.file_id and h.language = g.language where m.kind = 'embedded' and t.id <> m.symbol_id",
    ),
    "file_names": (
        lambda x: x.files.select("id", P.basename(F.col("path")).alias("base"), P.stem(F.col("path")).alias("stem")),
        f"select id, string_split(path, '/')[-1] as base, {STEM.format('path')} as stem from cx_files",
    ),
    "import_modules": (
        lambda x: x.imports.select("id", P.module_source(F.col("source")).alias("module"), P.package_part(F.replace("source", F.lit("/"), F.lit("."))).alias("package")),
        f"select id, {MODULE.format('source')} as module, array_to_string(list_slice(string_split(replace(source, '/', '.'), '.'), 1, -2), '.') as package from cx_imports",
    ),
    "bare_types": (
        lambda x: x.function_parameters.select("id", P.without_pointer(F.concat(F.lit("*&"), F.col("type_expr"))).alias("type_expr")),
        "select id, ltrim(concat('*&', type_expr), '*& ') as type_expr from cx_function_parameters",
    ),
}
