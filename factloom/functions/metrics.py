"""Counts that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ref_counts(facts) -> DataFrame:
    """id, ref_count, external_ref_count of every referenced symbol; a reference from another file is external.

    References and symbols meet on their keys; the counts are summed per task before they move.
    """
    links = facts.resolved_references.select("reference_id", F.col("target_symbol_id").alias("id"))
    refs = facts.references.select(F.col("id").alias("reference_id"), F.col("file_id").alias("from_file"))
    symbols = facts.symbols.select("id", "file_id")
    pairs = links.join(refs, "reference_id").join(symbols, "id")
    outside = F.when(F.col("from_file") != F.col("file_id"), 1).otherwise(0)
    return pairs.groupBy("id").agg(F.count("*").alias("ref_count"), F.sum(outside).cast("long").alias("external_ref_count"))


def degree(facts, end: str, name: str) -> DataFrame:
    """id and the number of call edges at one end: caller or callee."""
    return facts.call_graph.groupBy(F.col(f"{end}_symbol_id").alias("id")).agg(F.count("*").alias(name))


def symbol_rows(facts, symbols: DataFrame | None = None, counts: bool = True) -> DataFrame:
    """Symbols with file_path and reference counts, the row that most queries return."""
    symbols = facts.symbols if symbols is None else symbols
    files = facts.files.select(F.col("id").alias("file_id"), "path")
    out = symbols.join(files, "file_id", "left").withColumn("file_path", F.coalesce("path", F.lit(""))).drop("path")
    if counts:
        out = out.join(ref_counts(facts), "id", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("ref_count", "external_ref_count")})
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("ref_count", "external_ref_count")})
    out = out.withColumn("internal_ref_count", F.col("ref_count") - F.col("external_ref_count"))
    return out.select(*SYMBOL)


SYMBOL = ["id", "file_id", "name", "kind", "visibility", "modifiers", "start_line", "start_col", "end_line", "end_col", "parent_symbol_id", "file_path", "ref_count", "external_ref_count", "internal_ref_count"]


def located(facts, rows: DataFrame) -> DataFrame:
    """rows with file_path for their file_id; rows without a file are dropped."""
    return rows.join(facts.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
