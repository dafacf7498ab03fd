"""Lookups along links: references, calls, imports, implementations and other facts of one symbol or file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.metrics import located
from factloom.functions.patterns import ends_like

PLACE = ["start_line", "start_col", "end_line", "end_col"]


def references_to(facts, symbol_id: int) -> DataFrame:
    links = facts.resolved_references.filter(F.col("target_symbol_id") == symbol_id).select("reference_id")
    refs = facts.references.select(F.col("id").alias("reference_id"), "file_id", *PLACE)
    return located(facts, links.join(refs, "reference_id")).select("reference_id", "file_path", *PLACE)


def _places(facts, ids: DataFrame) -> DataFrame:
    symbols = facts.symbols.select(F.col("id").alias("symbol_id"), "name", "file_id", *PLACE)
    return located(facts, ids.join(symbols, "symbol_id")).select("symbol_id", "name", "kind", "file_path", *PLACE)


def implementations(facts, interface_id: int) -> DataFrame:
    return _places(facts, facts.implementations.filter(F.col("interface_symbol_id") == interface_id).select(F.col("type_symbol_id").alias("symbol_id"), "kind"))


def implements_interfaces(facts, type_id: int) -> DataFrame:
    return _places(facts, facts.implementations.filter(F.col("type_symbol_id") == type_id).select(F.col("interface_symbol_id").alias("symbol_id"), "kind"))


def callers(facts, symbol_id: int) -> DataFrame:
    return facts.call_graph.filter(F.col("callee_symbol_id") == symbol_id)


def callees(facts, symbol_id: int) -> DataFrame:
    return facts.call_graph.filter(F.col("caller_symbol_id") == symbol_id)


def dependencies(facts, file_id: int) -> DataFrame:
    return facts.imports.filter(F.col("file_id") == file_id)


def dependents(facts, source: str) -> DataFrame:
    return facts.imports.filter(ends_like(F.col("source"), source))


def of(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows of a fact table by one key."""
    return rows.filter(F.col(column) == value)


def impl_pairs(facts) -> DataFrame:
    names = facts.symbols.select("id", "name")
    a = names.select(F.col("id").alias("type_symbol_id"), F.col("name").alias("type_name"))
    b = names.select(F.col("id").alias("interface_symbol_id"), F.col("name").alias("interface_name"))
    return facts.implementations.join(a, "type_symbol_id").join(b, "interface_symbol_id").select("id", "type_name", "interface_name", "kind")


def call_pairs(facts) -> DataFrame:
    names = facts.symbols.select("id", "name")
    a = names.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller_name"))
    b = names.select(F.col("id").alias("callee_symbol_id"), F.col("name").alias("callee_name"))
    return facts.call_graph.join(a, "caller_symbol_id").join(b, "callee_symbol_id").select("id", "caller_name", "callee_name", "line", "col")


def call_degree(facts) -> DataFrame:
    """Fan-in and fan-out of every symbol on a call edge, in one exchange of partial counts."""
    out = facts.call_graph.select(F.col("caller_symbol_id").alias("id"), F.lit(0).alias("fan_in"), F.lit(1).alias("fan_out"))
    into = facts.call_graph.select(F.col("callee_symbol_id").alias("id"), F.lit(1).alias("fan_in"), F.lit(0).alias("fan_out"))
    return out.unionByName(into).groupBy("id").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


def type_hierarchy(facts, symbol_id: int) -> DataFrame:
    """relation, kind and symbol on the other end: implements, implemented_by, composes, composed_by, extension."""
    sides = [
        (facts.implementations, "type_symbol_id", "interface_symbol_id", "kind", "implements"),
        (facts.implementations, "interface_symbol_id", "type_symbol_id", "kind", "implemented_by"),
        (facts.type_compositions, "composite_symbol_id", "component_symbol_id", "composition_kind", "composes"),
        (facts.type_compositions, "component_symbol_id", "composite_symbol_id", "composition_kind", "composed_by"),
        (facts.extension_bindings, "extended_type_symbol_id", "member_symbol_id", "kind", "extension"),
    ]
    parts = [rows.filter(F.col(own) == symbol_id).select(F.lit(name).alias("relation"), F.col(kind).alias("relation_kind"), F.col(other).alias("id")) for rows, own, other, kind, name in sides]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return facts.symbols.select("id", "name", "kind").join(F.broadcast(out), "id").select("relation", "relation_kind", "id", "name", "kind")
