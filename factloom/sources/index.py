"""A source tree as fact tables on disk: files and facts, then links, calls and implementations.

Every table is written as Parquet below one folder, so a lost executor costs
tasks and no stage is computed twice. A run writes a new version beside the last
one, which counts from the moment its metadata are there. Files whose hash is known
are not parsed again, and only references in files that a change can reach are
resolved again; with other rules or ``force`` everything is. ``Indexed`` gives the
tables the names and columns that the operators read.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import incremental as I
from factloom.operators import languages as N
from factloom.operators import resolve as R
from factloom.operators.graph import cut
from factloom.sources.files import FACT, source_facts, source_files

SPAN = ("start_line", "start_col", "end_line", "end_col")
#: Columns of each table as SQL over the rows of a fact.
COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "symbols": ("symbol", ("id", "file_id", "name", "kind", "split_part(detail, ':', 1) as visibility", "if(detail like '%:%', concat('[\"', replace(split_part(detail, ':', 2), ',', '\",\"'), '\"]'), '[]') as modifiers", *SPAN, "owner as parent_symbol_id")),
    "scopes": ("scope", ("id", "file_id", "cast(nullif(detail, '') as bigint) as symbol_id", "kind", *SPAN, "owner as parent_scope_id")),
    "references": ("reference", ("id", "file_id", "name", *SPAN, "kind as context")),
    "imports": (
        "import",
        (
            "id",
            "file_id",
            "name as source",
            "if(kind in ('name', 'named', 'wildcard'), nullif(split_part(detail, ':', 1), ''), cast(null as string)) as imported_name",
            "nullif(if(kind in ('name', 'named', 'wildcard'), split_part(detail, ':', 2), if(kind = 'reexport', '', detail)), '') as local_alias",
            "kind",
            "'file' as scope",
        ),
    ),
    "type_members": ("member", ("id", "owner as symbol_id", "name", "kind", "regexp_replace(detail, '^[^:]*:?', '') as type_expr", "split_part(detail, ':', 1) as visibility")),
    "function_parameters": (
        "parameter",
        ("id", "owner as symbol_id", "name", "cast(split_part(detail, ':', 1) as int) as ordinal", "regexp_replace(detail, '^[0-9]+:', '') as type_expr", "kind = 'receiver' as is_receiver", "kind = 'return' as is_return", "false as has_default", "'' as default_expr"),
    ),
    "type_parameters": (
        "type_parameter",
        ("id", "owner as symbol_id", "name", "cast(split_part(detail, ':', 1) as int) as ordinal", "'' as variance", "kind as param_kind", "regexp_replace(detail, '^[0-9]+:', '') as constraints"),
    ),
    "annotations": ("annotation", ("id", "owner as target_symbol_id", "name", "cast(null as bigint) as resolved_symbol_id", "detail as arguments", "file_id", "start_line as line", "start_col as col")),
    "reexports": ("import", ("id", "file_id", "cast(null as bigint) as original_symbol_id", "detail as exported_name")),
}
EMPTY = {
    "symbol_fragments": "id long, symbol_id long, file_id long, start_line int, start_col int, end_line int, end_col int, is_primary boolean",
}
#: Stated, as a tree without facts leaves no file to infer it from.
STORED_FACT = FACT.replace("path string, ", "") + ", file_id long"
#: Modules whose rules make the tables.
RULES = ("sources/files.py", "sources/lexical.py", "sources/index.py", "operators/resolve.py", "operators/languages.py")
STORED = ("files", "resolved_references", "call_graph", "implementations", "extension_bindings", "type_compositions")


def rules_hash() -> str:
    """SHA-256 of the modules whose rules make the tables."""
    home = Path(__file__).resolve().parents[1]
    return hashlib.sha256(b"\0".join((home / x).read_bytes() for x in RULES)).hexdigest()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Whole versions below a folder, ascending: those whose metadata are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/metadata/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(x.getPath().getParent().getParent().getName().partition("=")[2]) for x in found)


class Indexed:
    """Fact tables of an indexed tree, by short name; the last version unless another is named."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.root = spark, folder.rstrip("/")
        known = versions(spark, self.root) if version is None else []
        self.version = version if version is not None else (known[-1] if known else 0)
        self.folder = f"{self.root}/version={self.version}"

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            return self.table(name)
        if name in EMPTY:
            return self.spark.createDataFrame([], EMPTY[name])
        if name not in COLUMNS:
            raise AttributeError(name)
        fact, columns = COLUMNS[name]
        rows = self.table("facts").filter(F.col("fact") == fact)
        return (rows.filter("kind = 'reexport'") if name == "reexports" else rows).selectExpr(*columns)

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(STORED_FACT) if name == "facts" else self.spark.read
        return reader.parquet(f"{self.folder}/{name}")


class Within:
    """Fact tables whose references are those of some files (file_id)."""

    def __init__(self, facts: Indexed, files: DataFrame):
        self._facts, self._files = facts, files

    def __getattr__(self, name: str):
        rows = getattr(self._facts, name)
        return rows.join(self._files, "file_id", "left_semi") if name == "references" else rows


def by_base_name(facts: Indexed, kinds: tuple[str, ...], member: str, link: str, languages: tuple[str, ...] = ()) -> DataFrame:
    """owner, target, language of members that name a type of some kind in the same language; the first such type counts."""
    files = facts.files.filter(F.col("language").isin(*languages)) if languages else facts.files
    language = files.select(F.col("id").alias("file_id"), "language")
    types = facts.symbols.filter(F.col("kind").isin(*kinds)).join(language, "file_id").groupBy("language", "name").agg(F.min("id").alias("target"))
    owners = facts.symbols.select(F.col("id").alias("symbol_id"), "file_id").join(language, "file_id")
    rows = facts.type_members.filter(F.col("kind") == member).select("symbol_id", "name").join(owners, "symbol_id")
    return rows.join(types, ["language", "name"]).filter("symbol_id <> target").select("symbol_id", "target", "file_id", F.lit(link).alias("kind"))


def implementations(facts: Indexed) -> DataFrame:
    """Types that name an interface, and Go types that have all its methods."""
    named = by_base_name(facts, ("interface", "trait"), "base_class", "explicit").select(F.col("symbol_id").alias("type_symbol_id"), F.col("target").alias("interface_symbol_id"), "kind", "file_id")
    home = facts.symbols.select(F.col("id").alias("type_symbol_id"), "file_id").join(facts.files.filter("language = 'go'").select(F.col("id").alias("file_id")), "file_id")
    implied = R.interface_satisfaction(facts).join(home, "type_symbol_id").select("type_symbol_id", "interface_symbol_id", F.lit("implicit").alias("kind"), "file_id")
    classes = by_base_name(facts, ("class",), "base_class", "explicit", ("python", "ruby", "cpp")).select(F.col("symbol_id").alias("type_symbol_id"), F.col("target").alias("interface_symbol_id"), "kind", "file_id")
    homes = facts.symbols.select(F.col("id").alias("type_symbol_id"), "file_id")
    ruled = N.implementations(facts).join(homes, "type_symbol_id").select(*named.columns)
    every = named.unionByName(implied).unionByName(classes).unionByName(ruled)
    rows = every.groupBy("type_symbol_id", "interface_symbol_id").agg(F.min("kind").alias("kind"), F.min("file_id").alias("file_id"))
    return rows.select(F.xxhash64("type_symbol_id", "interface_symbol_id", "kind").alias("id"), *rows.columns)


def compositions(facts: Indexed) -> DataFrame:
    kinds = ("class", "struct", "interface", "trait", "module")
    rows = by_base_name(facts, kinds, "embedded", "embedding").unionByName(by_base_name(facts, ("class",), "base_class", "inheritance"))
    return rows.select(F.xxhash64("symbol_id", "target", "kind").alias("id"), F.col("symbol_id").alias("composite_symbol_id"), F.col("target").alias("component_symbol_id"), F.col("kind").alias("composition_kind")).distinct()


def touched(before: Indexed, facts: Indexed, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """file_id of files whose references must be resolved again: those that a change reaches, and those that name a symbol that came."""
    moved = changed.unionByName(gone)
    old = before.symbols.join(moved, "file_id", "left_semi")
    new = facts.symbols.join(changed, "file_id", "left_semi")
    came = new.join(old.select("file_id", "name", "kind"), ["file_id", "name", "kind"], "left_anti").select("name").distinct()
    named = facts.references.join(came, "name", "left_semi").select("file_id")
    return I.blast_radius(before, moved, old.select("id")).unionByName(named).distinct()


def index(spark: SparkSession, root: str, folder: str, languages: tuple[str, ...] = (), force: bool = False) -> Indexed:
    """Reads a tree below root and writes its fact tables as a new version below folder; the version before it stays until then."""
    before = Indexed(spark, folder)
    rules = f"{rules_hash()} {','.join(languages)} {root}"
    known = before.version and not force and before.table("metadata").filter(F.col("key") == "rules").first().value == rules
    facts = Indexed(spark, folder, before.version + 1)

    def put(rows: DataFrame, name: str, *partition: str) -> None:
        rows.write.mode("overwrite").partitionBy(*partition).parquet(f"{facts.folder}/{name}")

    key = F.xxhash64("path")
    found = cut(source_files(spark, root, languages).withColumn("id", key))
    put(found.select("id", "path", "language", "hash", "line_count"), "files")
    if known:
        changed = I.changed_files(before.files, found)
        gone = I.stale_files(before.files, found).select(F.col("id").alias("file_id"))
        fresh = source_facts(changed).withColumn("file_id", key).drop("path")
        moved = changed.select(F.col("id").alias("file_id")).unionByName(gone)
        kept = before.table("facts").join(moved, "file_id", "left_anti")
        put(kept.unionByName(fresh), "facts", "fact")
        put(compositions(facts), "type_compositions")
        radius = cut(touched(before, facts, changed.select(F.col("id").alias("file_id")), gone))
        still = before.resolved_references.join(facts.references.join(radius, "file_id", "left_anti").select(F.col("id").alias("reference_id")), "reference_id", "left_semi")
        still = I.without_links(still, before.symbols.join(facts.symbols.select("id"), "id", "left_anti"))
        links = still.drop("id").unionByName(N.resolve(Within(facts, radius)))
    else:
        radius = found.select(F.col("id").alias("file_id"))
        put(source_facts(found.drop("id")).withColumn("file_id", key).drop("path"), "facts", "fact")
        put(compositions(facts), "type_compositions")
        links = N.resolve(facts)
    put(links.withColumn("id", F.col("reference_id")), "resolved_references")
    place = facts.references.select(F.col("id").alias("reference_id"), "file_id", F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    calls = R.call_edges(facts).join(place, "reference_id")
    put(calls.select(F.xxhash64("reference_id", "callee_symbol_id").alias("id"), "caller_symbol_id", "callee_symbol_id", "file_id", "line", "col"), "call_graph")
    bound = R.extension_bindings(facts)
    put(bound.select(F.col("member_symbol_id").alias("id"), *bound.columns, F.lit("method").alias("kind"), F.lit("").alias("constraints"), F.lit(False).alias("is_default_impl")), "extension_bindings")
    put(implementations(facts), "implementations")
    told = [("rules", rules), ("resolved_files", str(radius.count())), ("files", str(found.count()))]
    put(spark.createDataFrame(told, "key string, value string").withColumn("at", F.current_timestamp()).coalesce(1), "metadata")
    if before.version:
        old = spark._jvm.org.apache.hadoop.fs.Path(before.folder)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return facts
