"""Incremental maintenance: which files changed, what changed in them, and what must be resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.discovery import PACKAGE_KINDS


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """New files whose path and hash are not known."""
    return new.join(old.select("path", "hash"), ["path", "hash"], "left_anti")


def stale_files(old: DataFrame, found: DataFrame, prefix: str = "") -> DataFrame:
    """Known files below prefix that are gone."""
    return old.filter(F.col("path").startswith(prefix)).join(found.select("path"), "path", "left_anti")


def signature_hash(symbols: DataFrame, members: DataFrame, parameters: DataFrame, type_parameters: DataFrame) -> DataFrame:
    """id, signature_hash: SHA-256 of a symbol's own lines and the sorted lines of its parts."""
    truth = lambda c: F.when(F.col(c), "true").otherwise("false")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def lines(rows: DataFrame, name: str, *parts) -> DataFrame:
        line = F.concat(F.lit(f"{name}:"), F.concat_ws(":", *parts), F.lit("\n"))
        return rows.groupBy(F.col("symbol_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias(name))

    kept = F.array_join(F.sort_array(F.from_json("modifiers", "array<string>")), ",")
    out = symbols.select("id", F.concat(F.lit("name:"), "name", F.lit("\nkind:"), "kind", F.lit("\nvisibility:"), "visibility", F.lit("\nmodifiers:"), kept, F.lit("\n")).alias("own"))
    out = out.join(lines(members, "member", text("name"), text("kind"), text("type_expr"), text("visibility")), "id", "left")
    out = out.join(lines(parameters, "param", text("name"), text("ordinal"), text("type_expr"), truth("is_receiver"), truth("is_return")), "id", "left")
    out = out.join(lines(type_parameters, "typeparam", text("name"), text("ordinal"), text("variance"), text("param_kind"), text("constraints")), "id", "left")
    whole = F.concat("own", *[F.coalesce(c, F.lit("")) for c in ("member", "param", "typeparam")])
    return out.select("id", F.sha2(whole.cast("binary"), 256).alias("signature_hash"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, kind, parent, status of symbols removed, added or changed; both have name, kind, parent, signature_hash."""
    keys = ["name", "kind", "parent"]
    a = old.groupBy(*keys).agg(F.max("signature_hash").alias("before"))
    b = new.groupBy(*keys).agg(F.max("signature_hash").alias("after"))
    rows = a.join(b, keys, "full")
    status = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "changed")
    return rows.withColumn("status", status).filter("status is not null").select(*keys, "status")


def blast_radius(facts, changed: DataFrame, symbols: DataFrame, moved: bool = True) -> DataFrame:
    """file_id: the changed files, files that refer to changed or removed symbols, and importers of the files' packages if symbols came or went.

    changed: file_id. symbols: id of changed and removed symbols.
    """
    links = facts.resolved_references.join(symbols.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi")
    users = facts.references.select(F.col("id").alias("reference_id"), "file_id").join(links.select("reference_id"), "reference_id", "left_semi").select("file_id")
    out = changed.select("file_id").unionByName(users)
    if moved:
        names = facts.symbols.filter(F.col("kind").isin(*PACKAGE_KINDS)).join(changed.select("file_id"), "file_id", "left_semi").select("name").distinct()
        tail = facts.imports.select("file_id", F.explode(F.array_distinct(F.array("source", F.element_at(F.split("source", "/"), -1)))).alias("name"))
        out = out.unionByName(tail.join(names, "name", "left_semi").select("file_id"))
    return out.distinct()


def without_files(tables: dict[str, DataFrame], files: DataFrame, columns: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of some files; columns names the file column of each table."""
    return {name: rows.join(files.select(F.col("file_id").alias(columns[name])), columns[name], "left_anti") if name in columns else rows for name, rows in tables.items()}


def gone_symbols(symbols: DataFrame, gone) -> DataFrame:
    """id of symbols on which the condition gone holds, unless a symbol that stays has the same id."""
    stays = symbols.filter(~F.coalesce(gone, F.lit(False))).select("id")
    return symbols.filter(gone).select("id").join(stays, "id", "left_anti")


def without_links(links: DataFrame, gone: DataFrame, column: str = "target_symbol_id") -> DataFrame:
    """Links whose target is not among the symbols (id) that are gone."""
    return links.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def cleared_annotations(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    """Annotations, those that resolve to a symbol that is gone resolving to nothing; as in the SQL, a row for each symbol gone with that id."""
    gone = gone.select(F.col("id").alias("resolved_symbol_id"), F.lit(True).alias("gone"))
    rows = annotations.join(gone, "resolved_symbol_id", "left")
    return rows.withColumn("resolved_symbol_id", F.when(F.col("gone").isNull(), F.col("resolved_symbol_id"))).select(*annotations.columns)


def deterministic_id(*columns: str):
    """A key from natural keys, the same in every run and engine; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
