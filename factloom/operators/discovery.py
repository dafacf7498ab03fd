"""Listing, searching and summarising symbols, files and packages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions.metrics import ref_counts, symbol_rows

PACKAGE_KINDS = ("package", "module", "namespace")
SYMBOL_SORTS = {"name": "name", "kind": "kind", "file": "file_path", "ref_count": "ref_count", "external_ref_count": "external_ref_count"}
FILE_SORTS = {"name": "path", "file": "path", "line_count": "line_count"}


@dataclass(frozen=True)
class SymbolFilter:
    """All set conditions must hold."""

    kinds: tuple[str, ...] = ()
    visibility: str | None = None
    modifiers: tuple[str, ...] = ()
    file_id: int | None = None
    parent_id: int | None = None
    path_prefix: str | None = None
    ref_count_min: int | None = None
    ref_count_max: int | None = None

    def on_symbols(self, symbols: DataFrame) -> DataFrame:
        """Conditions on the symbols' own columns, so that they reach the scan."""
        if self.kinds:
            symbols = symbols.filter(F.col("kind").isin(*self.kinds))
        for column, value in (("visibility", self.visibility), ("file_id", self.file_id), ("parent_symbol_id", self.parent_id)):
            if value is not None:
                symbols = symbols.filter(F.col(column) == value)
        held = F.from_json("modifiers", "array<string>")
        for x in self.modifiers:
            symbols = symbols.filter(F.array_contains(held, x))
        return symbols

    def on_rows(self, rows: DataFrame) -> DataFrame:
        if self.path_prefix:
            rows = rows.filter(F.col("file_path").ilike(P.under(self.path_prefix)))
        if self.ref_count_min is not None:
            rows = rows.filter(F.col("ref_count") >= self.ref_count_min)
        if self.ref_count_max is not None:
            rows = rows.filter(F.col("ref_count") <= self.ref_count_max)
        return rows


def paged(rows: DataFrame, column: str, order: str = "asc", limit: int | None = None, offset: int | None = None, key: str = "id") -> DataFrame:
    """A page of rows in a total order."""
    n, skip = P.page(limit, offset)
    by = F.desc(column) if order == "desc" else F.asc(column)
    return rows.orderBy(by, key).offset(skip).limit(n)


def symbols(facts, where: SymbolFilter = SymbolFilter()) -> DataFrame:
    """Every symbol that passes; its count is the total, ``paged`` gives a page."""
    return where.on_rows(symbol_rows(facts, where.on_symbols(facts.symbols)))


def symbol_page(facts, where: SymbolFilter = SymbolFilter(), sort: str = "name", order: str = "asc", limit: int | None = None, offset: int | None = None) -> DataFrame:
    return paged(symbols(facts, where), SYMBOL_SORTS.get(sort, "name"), order, limit, offset)


def files(facts, prefix: str | None = None, language: str | None = None) -> DataFrame:
    rows = facts.files
    if prefix:
        rows = rows.filter(F.col("path").ilike(P.under(prefix)))
    return rows.filter(F.col("language") == language) if language else rows


def file_page(facts, prefix: str | None = None, language: str | None = None, sort: str = "path", order: str = "asc", limit: int | None = None, offset: int | None = None) -> DataFrame:
    return paged(files(facts, prefix, language), FILE_SORTS.get(sort, "path"), order, limit, offset)


def packages(facts, prefix: str | None = None) -> DataFrame:
    return symbols(facts, SymbolFilter(kinds=PACKAGE_KINDS, path_prefix=prefix))


def search(facts, pattern: str, where: SymbolFilter = SymbolFilter()) -> DataFrame:
    """Symbols whose name matches a glob, whatever the case of ASCII letters."""
    like = P.glob(pattern)
    own = where.on_symbols(facts.symbols)
    return where.on_rows(symbol_rows(facts, own.filter(F.col("name").ilike(like)) if like else own))


def language_stats(facts) -> DataFrame:
    """Files, lines and symbols by language."""
    per_file = facts.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    rows = facts.files.join(per_file, "id", "left")
    return rows.groupBy("language").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("line_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("symbol_count"))


def kinds_by_language(facts) -> DataFrame:
    rows = facts.symbols.select("file_id", "kind").join(facts.files.select(F.col("id").alias("file_id"), "language"), "file_id")
    return rows.groupBy("language", "kind").agg(F.count("*").alias("symbol_count"))


def package_count(facts) -> DataFrame:
    return facts.symbols.filter(F.col("kind").isin(*PACKAGE_KINDS)).agg(F.count("*").alias("package_count"))


def top_symbols(facts, n: int) -> DataFrame:
    """The n symbols most referenced from other files; none for n <= 0. Of symbols with one id, packages are last."""
    rows = symbol_rows(facts).filter("ref_count > 0")
    return rows.orderBy(F.desc("external_ref_count"), "id", F.col("kind").isin(*PACKAGE_KINDS), "file_id", "name").limit(max(n, 0))


def package_symbol(facts, path: str | None = None, symbol_id: int | None = None) -> DataFrame:
    """id, name, prefix of one package: by id, else the one with the smallest id below a path. One row or none."""
    rows = facts.symbols.filter(F.col("kind").isin(*PACKAGE_KINDS)).join(facts.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    rows = rows.filter(F.col("id") == symbol_id) if symbol_id is not None else rows.filter(F.col("path").ilike(P.under(path or "")))
    return rows.select("id", "name", P.directory(F.col("path")).alias("prefix")).orderBy("id").limit(1)


def package_files(facts, package: DataFrame) -> DataFrame:
    """Files below a package's directory; package has one row, so it is broadcast."""
    return facts.files.join(F.broadcast(package.select("prefix")), F.col("path").startswith(F.col("prefix")), "left_semi")


def package_exported(facts, package: DataFrame) -> DataFrame:
    """Public symbols of a package that are not packages."""
    own = facts.symbols.filter((F.col("visibility") == "public") & ~F.col("kind").isin(*PACKAGE_KINDS))
    return symbol_rows(facts, own.join(package_files(facts, package).select(F.col("id").alias("file_id")), "file_id", "left_semi"))


def package_kinds(facts, package: DataFrame) -> DataFrame:
    rows = facts.symbols.join(package_files(facts, package).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return rows.groupBy("kind").agg(F.count("*").alias("symbol_count"))


def package_dependencies(facts, package: DataFrame) -> DataFrame:
    rows = facts.imports.join(package_files(facts, package).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return rows.select("source").distinct()


def package_dependents(facts, package: DataFrame) -> DataFrame:
    """Files outside a package that import it by name or by a path that ends in its name."""
    one = F.broadcast(package)
    source, name = F.lower("source"), F.lower("name")
    hits = facts.imports.join(one, (F.col("source") == F.col("name")) | source.endswith(F.concat(F.lit("/"), name))).select("file_id", "prefix")
    rows = hits.join(facts.files.select(F.col("id").alias("file_id"), "path"), "file_id").filter(~F.col("path").startswith(F.col("prefix")))
    return rows.select("path").distinct()


def unused(facts, where: SymbolFilter = SymbolFilter()) -> DataFrame:
    """Symbols that nothing refers to, packages aside; counts are 0, so bounds of counts are not asked."""
    own = where.on_symbols(facts.symbols).filter(~F.col("kind").isin(*PACKAGE_KINDS))
    own = own.join(facts.resolved_references.select(F.col("target_symbol_id").alias("id")), "id", "left_anti")
    rows = symbol_rows(facts, own, counts=False)
    return rows.filter(F.col("file_path").ilike(P.under(where.path_prefix))) if where.path_prefix else rows


def hotspots(facts, n: int) -> DataFrame:
    """The n symbols most referenced from other files, with their fan-in and fan-out."""
    if n < 0:
        raise ValueError("n must not be negative")
    files_ = facts.files.select(F.col("id").alias("file_id"), "path")
    rows = facts.symbols.select("id", "file_id", "name", "kind").join(ref_counts(facts), "id").join(files_, "file_id", "left")
    top = rows.orderBy(F.desc("external_ref_count"), "id").limit(n)
    # Only the few rows on top meet the degrees, and they are broadcast to them.
    few = F.broadcast(top)
    for end, name in (("callee", "caller_count"), ("caller", "callee_count")):
        calls = facts.call_graph.select(F.col(f"{end}_symbol_id").alias("id")).join(few.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias(name))
        top = top.join(calls, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return top.select("id", "name", "kind", F.coalesce("path", F.lit("")).alias("file_path"), "ref_count", "external_ref_count", "caller_count", "callee_count")
