"""Lookups by position: the symbol, definition or scope at a place, one by one or for many places."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.metrics import located, symbol_rows
from factloom.functions.patterns import contains
from factloom.operators.graph import cut, grown

#: Lines of a bucket in which spans and places meet by equality.
LINES = 64


def in_file(facts, path: str | int) -> DataFrame:
    """file_id of the files with a path, which several may have, or of one by its id."""
    return facts.files.filter(F.col("id" if isinstance(path, int) else "path") == path).select(F.col("id").alias("file_id"))


def narrowest() -> list[Column]:
    return [F.col("end_line") - F.col("start_line"), F.col("end_col") - F.col("start_col"), F.col("id")]


def weighed() -> list[Column]:
    """The order by which references choose their scope: lines weigh ten thousand columns."""
    return [(F.col("end_line") - F.col("start_line")) * 10000 + (F.col("end_col") - F.col("start_col")), F.col("id")]


def on_source(lengths: DataFrame, line: int, col: int) -> DataFrame:
    """file_id where a position lies within the text; lengths has file_id, line, length."""
    return lengths.filter((F.col("line") == line) & (F.col("length") > col)).select("file_id")


def symbol_at(facts, path: str | int, line: int, col: int, lengths: DataFrame | None = None) -> DataFrame:
    """The narrowest symbol that holds a position; with lengths, positions beyond the text have none."""
    files = in_file(facts, path)
    if lengths is not None:
        files = files.join(on_source(lengths, line, col), "file_id", "left_semi")
    rows = facts.symbols.filter(contains(line, col)).join(F.broadcast(files), "file_id", "left_semi")
    return symbol_rows(facts, rows.orderBy(*narrowest()).limit(1))


def innermost(places: DataFrame, spans: DataFrame, order: list[Column], key: str, out: str) -> DataFrame:
    """key and out, the id of the first span by order that holds each place; places without one are left out.

    places: key, file_id, line, col. Spans are exploded into buckets of lines,
    so that the range join becomes an equality join on file and bucket.
    """
    spans = spans.select("id", "file_id", "start_line", "start_col", "end_line", "end_col").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / LINES), F.floor(F.col("end_line") / LINES))))
    places = places.withColumn("bucket", F.floor(F.col("line") / LINES))
    held = places.join(grown(spans), ["file_id", "bucket"]).filter(contains(F.col("line"), F.col("col")))
    return held.groupBy(key).agg(F.min_by("id", F.struct(*[x.alias(f"o{k}") for k, x in enumerate(order)])).alias(out))


def reference_places(facts) -> DataFrame:
    return facts.references.select(F.col("id").alias("reference_id"), "file_id", F.col("start_line").alias("line"), F.col("start_col").alias("col"))


def symbol_at_batch(facts, places: DataFrame | None = None) -> DataFrame:
    """reference_id and symbol_id: the narrowest symbol around each reference."""
    return innermost(reference_places(facts) if places is None else places, facts.symbols.filter("file_id is not null"), narrowest(), "reference_id", "symbol_id")


def innermost_scope(facts, only: DataFrame | None = None) -> DataFrame:
    """reference_id and scope_id: the scope that a reference stands in, for all references or those with a reference_id in only."""
    places = reference_places(facts)
    if only is not None:
        places = places.join(grown(only.select("reference_id")), "reference_id", "left_semi")
    return innermost(places, facts.scopes, weighed(), "reference_id", "scope_id")


def definition_at(facts, path: str, line: int, col: int) -> DataFrame:
    """Places of all symbols that references at a position resolve to; duplicates kept."""
    refs = facts.references.filter(contains(line, col)).join(F.broadcast(in_file(facts, path)), "file_id", "left_semi")
    links = facts.resolved_references.join(F.broadcast(refs.select(F.col("id").alias("reference_id"))), "reference_id")
    symbols = facts.symbols.select(F.col("id").alias("target_symbol_id"), "file_id", "start_line", "start_col", "end_line", "end_col")
    return located(facts, links.select("reference_id", "target_symbol_id").join(symbols, "target_symbol_id")).select("reference_id", "target_symbol_id", "file_path", "start_line", "start_col", "end_line", "end_col")


def chains(facts, start: DataFrame | None = None) -> DataFrame:
    """start_id, depth, id, parent of the scopes from each of start (rows of scopes; else all) outwards, level by level until no parent is left.

    Where several scopes have one id, a chain goes on from each. A chain ends before a scope that it holds already, so
    scopes that lie around themselves have finite chains. Each level is written, so none is computed twice.
    """
    rows = facts.scopes.select("id", F.col("parent_scope_id").alias("parent"))
    own = rows if start is None else start.select("id", F.col("parent_scope_id").alias("parent"))
    level = own.select(F.col("id").alias("start_id"), F.lit(0).alias("depth"), "id", "parent", F.array("id").alias("path"))
    if start is not None:
        level = cut(level)
    out = level.drop("path")
    for depth in count(1):
        up = level.select("start_id", "path", F.col("parent").alias("id")).join(grown(rows), "id").filter(~F.array_contains("path", F.col("id")))
        level = cut(up.select("start_id", F.lit(depth).alias("depth"), "id", "parent", F.concat("path", F.array("id")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level.drop("path"))
    return out


def ancestors(facts, start: DataFrame | None = None) -> DataFrame:
    """start_id, depth and the columns of the scopes on the chains."""
    return chains(facts, start).drop("parent").join(grown(facts.scopes), "id")


def scope_at(facts, path: str | int, line: int, col: int) -> DataFrame:
    """The innermost scope at a position and all scopes around it; depth 0 is the innermost."""
    rows = facts.scopes.filter(contains(line, col)).join(F.broadcast(in_file(facts, path)), "file_id", "left_semi")
    return ancestors(facts, rows.orderBy(*narrowest()).limit(1)).drop("start_id")


def symbol_detail(facts, symbols: DataFrame) -> DataFrame:
    """Symbols (id) with parameters, members, type parameters and annotations as ordered arrays, empty if none."""
    out = symbol_rows(facts, facts.symbols.join(symbols.select("id"), "id", "left_semi"))
    parts = {
        "parameters": (facts.function_parameters, "symbol_id", ("ordinal", "id", "name", "type_expr", "is_receiver", "is_return", "has_default", "default_expr")),
        "members": (facts.type_members, "symbol_id", ("id", "name", "kind", "type_expr", "visibility")),
        "type_parameters": (facts.type_parameters, "symbol_id", ("ordinal", "id", "name", "variance", "param_kind", "constraints")),
        "annotations": (facts.annotations, "target_symbol_id", ("id", "name", "arguments", "line", "col")),
    }
    for name, (rows, key, columns) in parts.items():
        own = rows.join(symbols.select(F.col("id").alias(key)), key, "left_semi")
        lists = own.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def detail_rows(detail: DataFrame) -> DataFrame:
    """A symbol's detail with one row per list element: id, part, ordinal, name. Symbols with one id share their lists."""
    detail = detail.dropDuplicates(["id"])
    parts = [detail.select("id", F.lit(p).alias("part"), F.posexplode(F.transform(p, lambda x: x["name"])).alias("ordinal", "name")) for p in ("parameters", "members", "type_parameters", "annotations")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")
