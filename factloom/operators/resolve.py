"""Resolution of references to symbols.

Each pass is a DataFrame of candidates (reference_id, pass_no, tie1, tie2,
target_symbol_id, confidence, resolution_kind). Passes depend on each other by
precedence alone, so they are united and the first candidate of a reference
wins, in one exchange. A null target consumes a reference without a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.patterns import last_segment
from factloom.operators.discovery import PACKAGE_KINDS
from factloom.operators.graph import cut, grown, package_of_file
from factloom.operators.position import ancestors, innermost_scope

CALLERS = ("function", "method")


def candidate(rows: DataFrame, pass_no: int, tie1, tie2, confidence: float, kind: str) -> DataFrame:
    return rows.select("reference_id", F.lit(pass_no).alias("pass_no"), tie1.cast("long").alias("tie1"), tie2.cast("long").alias("tie2"), "target_symbol_id", F.lit(confidence).alias("confidence"), F.lit(kind).alias("resolution_kind"))


def winners(*passes: DataFrame) -> DataFrame:
    """The first candidate of every reference, null targets included."""
    rows = passes[0]
    for x in passes[1:]:
        rows = rows.unionByName(x)
    order = F.struct("pass_no", "tie1", "tie2", "target_symbol_id")
    best = rows.groupBy("reference_id").agg(F.min_by(F.struct("target_symbol_id", "confidence", "resolution_kind", "pass_no"), order).alias("w"))
    return best.select("reference_id", "w.*")


def resolved(won: DataFrame) -> DataFrame:
    return won.filter("target_symbol_id is not null")


def refs(facts) -> DataFrame:
    return facts.references.select(F.col("id").alias("reference_id"), "file_id", "name", F.col("start_line").alias("line"), F.col("start_col").alias("col"), "context")


def targets(facts) -> DataFrame:
    return facts.symbols.select(F.col("id").alias("target_symbol_id"), "name", F.col("file_id").alias("target_file"), "kind", "visibility", F.col("start_line").alias("target_line"))


def by_scope(facts, tie: str = "target_symbol_id") -> DataFrame:
    """Same file and name, first line within a scope around the reference, from the innermost out. Scopes are looked for around references with such a symbol only."""
    own = cut(refs(facts).join(grown(targets(facts).withColumnRenamed("target_file", "file_id")), ["file_id", "name"]).select("reference_id", "target_symbol_id", "target_line"))
    chain = ancestors(facts).select(F.col("start_id").alias("scope_id"), "depth", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    rows = own.join(grown(innermost_scope(facts, own)), "reference_id").join(grown(chain), "scope_id").filter(F.col("target_line").between(F.col("low"), F.col("high")))
    return candidate(rows, 1, F.col("depth"), F.col(tie), 1.0, "direct")


def by_file(facts, tie: str = "target_symbol_id") -> DataFrame:
    """Same file and name, packages aside."""
    rows = refs(facts).join(targets(facts).withColumnRenamed("target_file", "file_id"), ["file_id", "name"]).filter(~F.col("kind").isin(*PACKAGE_KINDS))
    return candidate(rows, 2, F.lit(0), F.col(tie), 0.9, "direct")


def local_symbols(facts) -> DataFrame:
    """id of variables that stand inside a function's scope; they cannot be reached from other files."""
    spans = facts.scopes.filter("kind = 'function'").select("file_id", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    rows = facts.symbols.filter("kind = 'variable'").join(spans, "file_id").filter(F.col("start_line").between(F.col("low"), F.col("high")))
    return rows.select(F.col("id").alias("target_symbol_id")).distinct()


def open_targets(facts, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Symbols that other files can reach: those of some kinds, else all but packages."""
    wanted = F.col("kind").isin(*kinds) if kinds else ~F.col("kind").isin(*PACKAGE_KINDS)
    rows = targets(facts).filter(wanted & F.col("target_file").isNotNull())
    return rows.join(local_symbols(facts), "target_symbol_id", "left_anti")


def first_two(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of a key the first by target_file and target_symbol_id, and the first of any other file: enough for references
    that look beyond their own file, however popular the key."""
    each = rows.groupBy(*keys, "target_file").agg(F.min("target_symbol_id").alias("target_symbol_id"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("target_file"))
    return each.withColumn("nth", nth).filter("nth <= 2").drop("nth")


def by_package(facts) -> DataFrame:
    """Same name in another file of the same package."""
    own = package_of_file(facts)
    left = refs(facts).join(own, "file_id")
    right = first_two(open_targets(facts).join(own.withColumnRenamed("file_id", "target_file"), "target_file"), "package", "name")
    rows = left.join(right, ["package", "name"]).filter("file_id <> target_file")
    return candidate(rows, 3, F.col("target_file"), F.col("target_symbol_id"), 1.0, "direct")


def imported_packages(facts) -> DataFrame:
    """file_id, package, alias of each import whose last segment names a package."""
    names = package_of_file(facts).select("package").distinct()
    rows = facts.imports.select("file_id", F.coalesce("local_alias", last_segment(F.col("source"))).alias("alias"), last_segment(F.col("source")).alias("package"))
    return rows.join(names, "package").distinct()


def by_import(facts) -> DataFrame:
    """Public symbols of that name in a package that the file imports."""
    files = package_of_file(facts).withColumnRenamed("file_id", "target_file")
    left = refs(facts).join(imported_packages(facts).select("file_id", "package").distinct(), "file_id")
    right = first_two(open_targets(facts).filter("visibility = 'public'").join(files, "target_file"), "package", "name")
    rows = left.join(right, ["package", "name"]).filter("file_id <> target_file")
    return candidate(rows, 4, F.col("target_file"), F.col("target_symbol_id"), 1.0, "import")


def aliases(facts) -> DataFrame:
    """References that are an import's alias; consumed without a row."""
    rows = refs(facts).join(imported_packages(facts).select("file_id", F.col("alias").alias("name")).distinct(), ["file_id", "name"], "left_semi")
    return candidate(rows.withColumn("target_symbol_id", F.lit(None).cast("long")), 0, F.lit(0), F.lit(0), 0.0, "import")


def by_qualifier(facts) -> DataFrame:
    """A name on the line of an import's alias, the first alias counting: public symbols of the alias's package."""
    imported = imported_packages(facts)
    heads = refs(facts).withColumnRenamed("name", "alias").join(imported, ["file_id", "alias"])
    first = heads.groupBy("file_id", "line").agg(F.min_by("package", F.struct("reference_id", "package")).alias("package"), F.min("reference_id").alias("head"))
    files = package_of_file(facts).withColumnRenamed("file_id", "target_file")
    right = first_two(open_targets(facts).filter("visibility = 'public'").join(files, "target_file"), "package", "name")
    rows = refs(facts).join(first, ["file_id", "line"]).filter("reference_id <> head").join(right, ["package", "name"])
    return candidate(rows, 5, F.col("target_file"), F.col("target_symbol_id"), 1.0, "import")


def by_member(facts) -> DataFrame:
    """Field accesses whose name is a member of a type in the same package: methods first, then other members; the target is the type."""
    own = package_of_file(facts)
    types = facts.symbols.filter(F.col("kind").isin("struct", "interface", "class", "enum") & F.col("file_id").isNotNull()).select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("target_file"))
    members = facts.type_members.select(F.col("symbol_id").alias("target_symbol_id"), "name", (F.col("kind") != "method").cast("int").alias("later")).distinct()
    right = members.join(types, "target_symbol_id").join(own.withColumnRenamed("file_id", "target_file"), "target_file")
    rows = refs(facts).filter("context = 'field_access'").join(own, "file_id").join(right, ["package", "name"])
    out = candidate(rows, 6, F.col("later"), F.col("target_symbol_id"), 0.8, "direct")
    return out.withColumn("confidence", F.when(F.col("tie1") == 0, 0.8).otherwise(0.7))


def by_name(facts) -> DataFrame:
    """The first open symbol of that name anywhere, by file and id; it is found once per name, not per pair."""
    first = open_targets(facts).groupBy("name").agg(F.min(F.struct("target_file", "target_symbol_id")).alias("t")).select("name", "t.*")
    return candidate(refs(facts).join(first, "name"), 7, F.col("target_file"), F.col("target_symbol_id"), 0.7, "direct")


PASSES = (aliases, by_scope, by_file, by_package, by_import, by_qualifier, by_member, by_name)


def resolve_all(facts) -> DataFrame:
    """Every reference's link; consumed and unresolved references have none."""
    return resolved(winners(*[f(facts) for f in PASSES]))


def call_edges(facts) -> DataFrame:
    """reference_id, caller_symbol_id, callee_symbol_id of links that are calls; the caller is the nearest callable around the reference."""
    kinds = facts.symbols.select(F.col("id").alias("target_symbol_id"), F.col("kind").alias("target_kind"))
    links = facts.resolved_references.select("reference_id", "target_symbol_id").join(grown(kinds), "target_symbol_id").join(grown(refs(facts).select("reference_id", "context")), "reference_id")
    wanted = links.filter((F.col("context") == "call") | ((F.col("context") == "field_access") & F.col("target_kind").isin(*CALLERS)))
    calls = cut(wanted.select("reference_id", F.col("target_symbol_id").alias("callee_symbol_id")).distinct())
    return calls.join(grown(innermost_scope(facts, calls)), "reference_id").join(grown(nearest_callable(facts)), "scope_id").drop("scope_id")


def nearest_callable(facts) -> DataFrame:
    """scope_id, caller_symbol_id: the callable that owns the nearest of the scopes around each scope, itself included."""
    owners = facts.symbols.filter(F.col("kind").isin(*CALLERS)).select(F.col("id").alias("caller_symbol_id"))
    chain = ancestors(facts).filter("kind = 'function'").select(F.col("start_id").alias("scope_id"), "depth", F.col("symbol_id").alias("caller_symbol_id")).join(grown(owners), "caller_symbol_id", "left_semi")
    return chain.groupBy("scope_id").agg(F.min_by("caller_symbol_id", F.struct("depth", "caller_symbol_id")).alias("caller_symbol_id"))


def interface_satisfaction(facts) -> DataFrame:
    """type_symbol_id, interface_symbol_id where a type has all methods of an interface that has any: division by counting."""
    methods = facts.type_members.filter("kind = 'method'").select("symbol_id", "name").distinct()
    kinds = facts.symbols.select(F.col("id").alias("symbol_id"), "kind")
    faces = methods.join(kinds.filter("kind = 'interface'"), "symbol_id").select(F.col("symbol_id").alias("interface_symbol_id"), "name")
    types = methods.join(kinds.filter("kind = 'struct'"), "symbol_id").select(F.col("symbol_id").alias("type_symbol_id"), "name")
    needed = faces.groupBy("interface_symbol_id").agg(F.count("*").alias("needed"))
    met = types.join(faces, "name").groupBy("type_symbol_id", "interface_symbol_id").agg(F.count("*").alias("met"))
    return met.join(needed, "interface_symbol_id").filter("met = needed").select("type_symbol_id", "interface_symbol_id", F.col("needed").alias("methods"))


def extension_bindings(facts) -> DataFrame:
    """Methods bound to the type that holds them."""
    types = facts.symbols.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("extended_type_expr"))
    rows = facts.symbols.filter("kind = 'method' and parent_symbol_id is not null").join(types, "parent_symbol_id")
    return rows.select(F.col("id").alias("member_symbol_id"), "extended_type_expr", F.col("parent_symbol_id").alias("extended_type_symbol_id"))


def inherited(bases: DataFrame, own: DataFrame) -> DataFrame:
    """class_id, name, method_id: own methods first, then those of bases in their order, depth first; cycles end.

    bases: class_id, base_id, ordinal. own: class_id, name, method_id. order is
    the path of ordinals, so a smaller one is met earlier in a depth-first walk.
    """
    level = own.select("class_id").unionByName(bases.select("class_id")).distinct().select("class_id", F.col("class_id").alias("at"), F.array().cast("array<long>").alias("order"), F.array("class_id").alias("path"))
    reach = level
    while True:
        level = level.join(bases.select(F.col("class_id").alias("at"), "base_id", "ordinal"), "at").filter(~F.array_contains("path", F.col("base_id")))
        level = level.select("class_id", F.col("base_id").alias("at"), F.concat("order", F.array(F.col("ordinal").cast("long"))).alias("order"), F.concat("path", F.array("base_id")).alias("path"))
        level = cut(level)
        if level.isEmpty():
            break
        reach = reach.unionByName(level)
    rows = reach.join(own.select(F.col("class_id").alias("at"), "name", "method_id"), "at")
    nth = F.row_number().over(Window.partitionBy("class_id", "name").orderBy("order", "method_id"))
    return rows.withColumn("nth", nth).filter("nth = 1").select("class_id", "name", "method_id")
