"""Resolution rules of single languages: imports by their names, members of classes, bases, structure, overrides.

Every rule is a DataFrame of candidates like those of ``resolve``, kept to files of
its languages on both sides. Where the first of several symbols counts, at most two
per key leave the symbols' side (the first, and the first of another file), so a
popular name costs a reference two candidates and not all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.operators import resolve as R
from factloom.operators.resolve import first_two

CLASSES = ("class", "struct", "trait", "module")
CALLABLE = ("function", "method", "static_method", "class_method", "property", "constructor")


def homes(facts, languages: tuple[str, ...]) -> DataFrame:
    """file_id, language and stem (the file's name without its ending) of files of some languages."""
    files = facts.files.filter(F.col("language").isin(*languages))
    return files.select(F.col("id").alias("file_id"), "language", P.stem(F.col("path")).alias("stem"))


def refs_in(facts, languages: tuple[str, ...], *contexts: str) -> DataFrame:
    rows = R.refs(facts).join(homes(facts, languages).select("file_id", "language"), "file_id")
    return rows.filter(F.col("context").isin(*contexts)) if contexts else rows


def public_targets(facts, languages: tuple[str, ...], kinds: tuple[str, ...] = ()) -> DataFrame:
    """Open symbols that are public, or have no visibility, in files of some languages."""
    rows = R.open_targets(facts, kinds).filter("visibility = 'public' or visibility is null")
    home = homes(facts, languages).select(F.col("file_id").alias("target_file"), "language", "stem")
    return rows.join(home, "target_file")


def named_import(facts, languages: tuple[str, ...], pass_no: int, confidence: float, any_language: bool = False) -> DataFrame:
    """A name that an import brings in: the first open symbol of the imported name in another file, whatever the module."""
    every = tuple(sorted(set(P.LANGUAGES.values())))
    first = first_two(public_targets(facts, every if any_language else languages).withColumnRenamed("name", "imported_name"), "imported_name", *(() if any_language else ("language",)))
    brought = facts.imports.filter("imported_name is not null").select("file_id", "imported_name", F.coalesce("local_alias", "imported_name").alias("name")).distinct()
    rows = refs_in(facts, languages).join(brought, ["file_id", "name"]).join(first, ["imported_name", *(() if any_language else ("language",))]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), confidence, "import")


def module_import(facts, languages: tuple[str, ...], pass_no: int, confidence: float) -> DataFrame:
    """A name in a file that imports or includes a module: its first public symbol of that name, the module being a file of that name."""
    asked = facts.imports.select("file_id", P.stem(P.module_source(F.col("source"))).alias("stem")).distinct()
    first = first_two(public_targets(facts, languages), "language", "stem", "name")
    rows = refs_in(facts, languages).join(asked, "file_id").join(first, ["language", "stem", "name"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), confidence, "import")


def included(facts, languages: tuple[str, ...], pass_no: int, kinds: tuple[str, ...] = ("header",), called=P.basename) -> DataFrame:
    """A name in a file that includes a file by what it is called (its name, ending and all): the first symbol of that name there."""
    home = homes(facts, languages).select("file_id", "language")
    files = facts.files.select(F.col("id").alias("target_file"), called(F.col("path")).alias("base")).join(home.withColumnRenamed("file_id", "target_file"), "target_file")
    asked = facts.imports.filter(F.col("kind").isin(*kinds)).select("file_id", P.basename(F.col("source")).alias("base")).distinct()
    first = first_two(R.open_targets(facts).join(files, "target_file"), "language", "base", "name")
    rows = refs_in(facts, languages).join(asked, "file_id").join(first, ["language", "base", "name"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), 1.0, "import")


def member_owner(facts, languages: tuple[str, ...], pass_no: int) -> DataFrame:
    """A field access: the first struct of the language that has a member of that name, whatever the file."""
    home = homes(facts, languages).select(F.col("file_id").alias("target_file"), "language")
    structs = facts.symbols.filter("kind = 'struct'").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("target_file")).join(home, "target_file")
    first = facts.type_members.select("symbol_id", "name").join(structs, "symbol_id").groupBy("language", "name").agg(F.min(F.struct("target_file", "symbol_id")).alias("t"))
    rows = refs_in(facts, languages, "field_access").join(first.select("language", "name", "t.target_file", F.col("t.symbol_id").alias("target_symbol_id")), ["language", "name"])
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), 0.7, "direct")


def default_import(facts, languages: tuple[str, ...], pass_no: int) -> DataFrame:
    """The local name of a default import: the first public symbol of the module's file."""
    asked = facts.imports.filter("kind = 'default' and local_alias is not null").select("file_id", F.col("local_alias").alias("name"), P.stem(P.module_source(F.col("source"))).alias("stem")).distinct()
    first = first_two(public_targets(facts, languages), "language", "stem")
    rows = refs_in(facts, languages).join(asked, ["file_id", "name"]).join(first, ["language", "stem"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), 0.8, "import")


def consumed(facts, languages: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Names that imports of some kinds make, which stand for a module; consumed without a row."""
    made = facts.imports.filter(F.col("kind").isin(*kinds)).select("file_id", F.coalesce("local_alias", P.stem(F.col("source"))).alias("name")).distinct()
    rows = refs_in(facts, languages).join(made, ["file_id", "name"], "left_semi").withColumn("target_symbol_id", F.lit(None).cast("long"))
    return R.candidate(rows, 0, F.lit(0), F.lit(0), 0.0, "import")


def wildcard(facts, languages: tuple[str, ...], pass_no: int) -> DataFrame:
    """In a file with a wildcard import: the first public symbol of that name, or one without visibility, in other files."""
    open_ = facts.imports.filter("kind = 'wildcard'").select("file_id").distinct()
    first = first_two(public_targets(facts, languages), "language", "name")
    rows = refs_in(facts, languages).join(open_, "file_id", "left_semi").join(first, ["language", "name"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), 0.7, "import")


def of_kind(facts, languages: tuple[str, ...], pass_no: int, contexts: tuple[str, ...], kinds: tuple[str, ...], confidence: float) -> DataFrame:
    """References of some contexts: the first symbol of some kinds with that name in another file of the language."""
    first = first_two(public_targets(facts, languages, kinds), "language", "name")
    rows = refs_in(facts, languages, *contexts).join(first, ["language", "name"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), confidence, "direct")


def class_methods(facts) -> DataFrame:
    """class_id, name, method_id: methods of each class with those that it inherits."""
    own = facts.symbols.filter(F.col("kind").isin(*CALLABLE) & F.col("parent_symbol_id").isNotNull()).select(F.col("parent_symbol_id").alias("class_id"), "name", F.col("id").alias("method_id"))
    own = own.groupBy("class_id", "name").agg(F.min("method_id").alias("method_id"))
    order = F.row_number().over(Window.partitionBy("composite_symbol_id").orderBy("id"))
    bases = facts.type_compositions.filter("composition_kind = 'inheritance'").withColumn("ordinal", order)
    return R.inherited(bases.select(F.col("composite_symbol_id").alias("class_id"), F.col("component_symbol_id").alias("base_id"), "ordinal"), own)


def in_class(facts, languages: tuple[str, ...], pass_no: int) -> DataFrame:
    """Calls and field accesses inside a class: its own method of that name, or an inherited one; else of a class in the file, else elsewhere."""
    home = homes(facts, languages).select(F.col("file_id").alias("target_file"), "language")
    classes = facts.symbols.filter(F.col("kind").isin(*CLASSES)).select(F.col("id").alias("class_id"), F.col("file_id").alias("target_file"), F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    methods = class_methods(facts).join(classes, "class_id").join(home, "target_file").withColumnRenamed("method_id", "target_symbol_id")
    asked = refs_in(facts, languages, "call", "field_access")
    own = asked.join(methods.withColumnRenamed("target_file", "file_id").drop("language"), ["file_id", "name"])
    inside = own.withColumn("tie", F.when(F.col("line").between(F.col("low"), F.col("high")), 0).otherwise(1))
    here = R.candidate(inside, pass_no, F.col("tie"), F.col("target_symbol_id"), 0.9, "direct").withColumn("confidence", F.when(F.col("tie1") == 0, 0.9).otherwise(0.8))
    far = asked.join(first_two(methods, "language", "name"), ["language", "name"]).filter("file_id <> target_file")
    return here.unionByName(R.candidate(far, pass_no + 1, F.col("target_file"), F.col("target_symbol_id"), 0.7, "direct"))


def decorators(facts, languages: tuple[str, ...]) -> DataFrame:
    """Annotations with the first function or class of their name as what they resolve to; others stay as they are."""
    home = homes(facts, languages)
    first = facts.symbols.filter(F.col("kind").isin("function", *CLASSES)).join(home, "file_id").groupBy("language", "name").agg(F.min(F.struct("file_id", "id")).alias("t")).select("language", "name", F.col("t.id").alias("found"))
    rows = facts.annotations.join(home.select("file_id", "language"), "file_id", "left").join(first, ["language", "name"], "left")
    return rows.withColumn("resolved_symbol_id", F.coalesce("found", "resolved_symbol_id")).select(*facts.annotations.columns)


def bases(facts, languages: tuple[str, ...], header: int, first_only: bool = False) -> DataFrame:
    """type_symbol_id, interface_symbol_id, kind of types named in a class's header, of so many lines: interfaces are implemented, classes extended."""
    types = facts.symbols.filter(F.col("kind").isin(*CLASSES)).select(F.col("id").alias("type_symbol_id"), "file_id", F.col("start_line").alias("low"))
    named = facts.symbols.filter(F.col("kind").isin("interface", *CLASSES)).join(homes(facts, languages), "file_id").select("language", "name", F.col("id").alias("interface_symbol_id"), F.when(F.col("kind").isin("interface", "trait"), "explicit").otherwise("extends").alias("kind"), F.col("file_id").alias("named_in"))
    if first_only:
        named = named.groupBy("language", "name").agg(F.min_by(F.struct("interface_symbol_id", "kind"), F.struct("named_in", "interface_symbol_id")).alias("t")).select("language", "name", "t.*")
    rows = refs_in(facts, languages, "type_annotation").join(types, "file_id").filter(F.col("line").between(F.col("low"), F.col("low") + header))
    rows = rows.join(named.drop("named_in"), ["language", "name"]).filter("type_symbol_id <> interface_symbol_id")
    return rows.select("type_symbol_id", "interface_symbol_id", "kind").distinct()


def methods_of(facts, languages: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """symbol_id and name of the methods of types of some kinds, from child symbols and from members."""
    types = facts.symbols.filter(F.col("kind").isin(*kinds)).join(homes(facts, languages), "file_id").select(F.col("id").alias("symbol_id"))
    children = facts.symbols.filter("kind = 'method' and parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("symbol_id"), "name")
    members = facts.type_members.filter("kind = 'method'").select("symbol_id", "name")
    return children.unionByName(members).distinct().join(types, "symbol_id", "left_semi")


def structural(facts, languages: tuple[str, ...], types: tuple[str, ...], faces: tuple[str, ...], kind: str) -> DataFrame:
    """type_symbol_id, interface_symbol_id, kind where a type has all methods of an interface that has any.

    Only an interface's rarest method makes pairs; they are then checked for all others, so a method that every type has
    makes none.
    """
    have = methods_of(facts, languages, types).select(F.col("symbol_id").alias("type_symbol_id"), "name")
    need = methods_of(facts, languages, faces).select(F.col("symbol_id").alias("interface_symbol_id"), "name")
    spread = have.groupBy("name").agg(F.count("*").alias("n"))
    rated = need.join(spread, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("interface_symbol_id").agg(F.min_by("name", F.struct("n", "name")).alias("name"), F.count("*").alias("needed"))
    pairs = have.join(rarest, "name").filter("type_symbol_id <> interface_symbol_id").select("type_symbol_id", "interface_symbol_id", "needed")
    met = pairs.join(need, "interface_symbol_id").join(have, ["type_symbol_id", "name"]).groupBy("type_symbol_id", "interface_symbol_id", "needed").agg(F.count("*").alias("met"))
    return met.filter("met = needed").select("type_symbol_id", "interface_symbol_id", F.lit(kind).alias("kind"))


def overrides(facts, languages: tuple[str, ...]) -> DataFrame:
    """member_symbol_id, overridden_symbol_id: methods of a class that a direct or further base has by the same name."""
    own = facts.symbols.filter("kind = 'method' and parent_symbol_id is not null").join(homes(facts, languages).select("file_id"), "file_id").select(F.col("parent_symbol_id").alias("class_id"), "name", F.col("id").alias("member_symbol_id"))
    bases_ = facts.type_compositions.filter("composition_kind = 'inheritance'").select(F.col("composite_symbol_id").alias("class_id"), F.col("component_symbol_id").alias("base_id")).filter("class_id <> base_id").distinct()
    theirs = class_methods(facts).select(F.col("class_id").alias("base_id"), "name", F.col("method_id").alias("overridden_symbol_id"))
    return own.join(bases_, "class_id").join(theirs, ["base_id", "name"]).filter("member_symbol_id <> overridden_symbol_id").select("member_symbol_id", "overridden_symbol_id").distinct()


def mixins(facts, languages: tuple[str, ...], kind: str) -> DataFrame:
    """type_symbol_id, interface_symbol_id, kind of embedded members that name a trait, module or class of the language; all matches."""
    home = homes(facts, languages).select("file_id", "language")
    named = facts.symbols.filter(F.col("kind").isin("interface", *CLASSES)).join(home, "file_id").select("language", "name", F.col("id").alias("interface_symbol_id"))
    owners = facts.symbols.join(home, "file_id").select(F.col("id").alias("symbol_id"), "language")
    rows = facts.type_members.filter("kind = 'embedded'").select("symbol_id", "name").join(owners, "symbol_id").join(named, ["language", "name"]).filter("symbol_id <> interface_symbol_id")
    return rows.select(F.col("symbol_id").alias("type_symbol_id"), "interface_symbol_id", F.lit(kind).alias("kind")).distinct()


def candidates(facts) -> list[DataFrame]:
    """The rules of single languages in their order; numbers lie between those of the rules for all."""
    script, c = ("typescript", "javascript"), ("c", "cpp")
    return [
        consumed(facts, ("python",), ("module",)),
        consumed(facts, script, ("namespace",)),
        named_import(facts, ("python", "rust"), 10, 0.9),
        named_import(facts, (*script, "php"), 10, 1.0),
        included(facts, c, 10),
        module_import(facts, (*script, *c), 11, 1.0),
        module_import(facts, ("ruby",), 11, 0.9),
        default_import(facts, script, 12),
        wildcard(facts, ("python",), 13),
        in_class(facts, ("python", "php", "ruby", "typescript", "javascript", "java", "rust", "cpp"), 14),
        member_owner(facts, ("c",), 16),
        of_kind(facts, ("php", "ruby"), 16, ("type_annotation", "call"), CLASSES, 0.8),
        of_kind(facts, c, 16, ("call", "type_annotation"), ("function", *CLASSES), 0.8),
    ]


def implementations(facts) -> DataFrame:
    """type_symbol_id, interface_symbol_id, kind by the rules of single languages."""
    found = [
        structural(facts, ("typescript",), ("class",), ("interface",), "structural"),
        structural(facts, ("rust",), ("struct", "enum"), ("trait",), "explicit"),
        bases(facts, ("java", "php"), 2),
        bases(facts, ("python", "ruby"), 0),
        bases(facts, ("cpp",), 0, first_only=True),
        mixins(facts, ("php",), "trait"),
        mixins(facts, ("ruby",), "mixin"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def by_name(facts, pass_no: int = 20) -> DataFrame:
    """The first open symbol of that name in another file of the same language."""
    every = tuple(sorted(set(P.LANGUAGES.values())))
    home = homes(facts, every).select(F.col("file_id").alias("target_file"), "language")
    first = first_two(R.open_targets(facts).join(home, "target_file"), "language", "name")
    rows = refs_in(facts, every).join(first, ["language", "name"]).filter("file_id <> target_file")
    return R.candidate(rows, pass_no, F.col("target_file"), F.col("target_symbol_id"), 0.7, "direct")


def resolve(facts) -> DataFrame:
    """Every reference's link by the rules for all languages, then those of its own, then by name within its language.

    Ids are hashes here, so of symbols of one file the first is the one that stands first.
    """
    near = [f(facts, "target_line") if f in (R.by_scope, R.by_file) else f(facts) for f in R.PASSES[:-1]]
    return R.resolved(R.winners(*near, *candidates(facts), by_name(facts)))
