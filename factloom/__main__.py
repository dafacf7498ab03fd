"""Command line: ``python -m factloom COMMAND DIRECTORY [arguments]``.

``index TREE --out FOLDER [--force] [--languages a,b]`` makes the fact tables, or brings them up to date; with
``--indexed`` the other commands read them, else the driver's tables. Commands that take arguments are listed in
COMMANDS; any query of the catalogue can be run by its name. The answer is one JSON document: command, results,
total_count and error.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.patterns import page
from factloom.operators import discovery as D
from factloom.operators import graph as G
from factloom.operators import links as L
from factloom.operators import position as S
from factloom.operators import resolve as R
from factloom.plans import registry
from factloom.plans.views import Facts
from factloom.sources.index import Indexed, index


def chosen(facts, got) -> int:
    """The symbol that --symbol names by id, or that lies at --path, --line and --col, or that --name names (the first by id)."""
    if got.symbol is not None:
        return got.symbol
    rows = S.symbol_at(facts, got.path, got.line, got.col) if got.path else facts.symbols.filter(F.col("name") == got.name).orderBy("id").limit(1)
    row = rows.select("id").first()
    if row is None:
        raise ValueError("no such symbol")
    return row.id


def file_of(facts, got) -> int:
    row = facts.files.filter(F.col("path") == got.path).select("id").first()
    if row is None:
        raise ValueError(f"no such file: {got.path}")
    return row.id


def where(got) -> D.SymbolFilter:
    return D.SymbolFilter(kinds=tuple(filter(None, got.kind.split(","))), visibility=got.visibility, path_prefix=got.prefix, ref_count_min=got.least, ref_count_max=got.most)


def one(facts, got) -> DataFrame:
    return facts.symbols.filter(F.col("id") == chosen(facts, got)).select("id")


def package(facts, got) -> DataFrame:
    return D.package_symbol(facts, path=got.path, symbol_id=got.symbol)


#: Commands with arguments, over the facts and the parsed arguments.
COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "symbol-at": lambda x, a: S.symbol_at(x, a.path, a.line, a.col),
    "definition": lambda x, a: S.definition_at(x, a.path, a.line, a.col),
    "scope-at": lambda x, a: S.scope_at(x, a.path, a.line, a.col),
    "references": lambda x, a: L.references_to(x, chosen(x, a)),
    "implementations": lambda x, a: L.implementations(x, chosen(x, a)),
    "implements": lambda x, a: L.implements_interfaces(x, chosen(x, a)),
    "callers": lambda x, a: L.callers(x, chosen(x, a)),
    "callees": lambda x, a: L.callees(x, chosen(x, a)),
    "dependencies": lambda x, a: L.dependencies(x, file_of(x, a)),
    "dependents": lambda x, a: L.dependents(x, a.name),
    "detail": lambda x, a: S.symbol_detail(x, one(x, a)),
    "symbols": lambda x, a: D.symbols(x, where(a)),
    "search": lambda x, a: D.search(x, a.name or "*", where(a)),
    "files": lambda x, a: D.files(x, a.prefix, a.language),
    "packages": lambda x, a: D.packages(x, a.prefix),
    "unused": lambda x, a: D.unused(x, where(a)),
    "hotspots": lambda x, a: D.hotspots(x, a.top),
    "summary": lambda x, a: D.language_stats(x),
    "kinds": lambda x, a: D.kinds_by_language(x),
    "package-exports": lambda x, a: D.package_exported(x, package(x, a)),
    "package-kinds": lambda x, a: D.package_kinds(x, package(x, a)),
    "transitive-callers": lambda x, a: G.transitive(x, chosen(x, a), a.depth, "callers")[0],
    "transitive-callees": lambda x, a: G.transitive(x, chosen(x, a), a.depth, "callees")[0],
    "hierarchy": lambda x, a: L.type_hierarchy(x, chosen(x, a)),
    "extensions": lambda x, a: L.of(x.extension_bindings, "extended_type_symbol_id", chosen(x, a)),
    "reexports": lambda x, a: L.of(x.reexports, "file_id", file_of(x, a)),
    "package-graph": lambda x, a: G.ranked(G.package_edges(x)),
    "cycles": lambda x, a: G.cycles(G.package_edges(x)),
    "resolved-by": lambda x, a: L.of(x.resolved_references, "reference_id", a.symbol),
    "call-edges": lambda x, a: R.call_edges(x),
}
SORTS = {**D.FILE_SORTS, **D.SYMBOL_SORTS}


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="factloom")
    args.add_argument("command", choices=["index", *COMMANDS, *sorted(registry.CATALOG)], metavar="COMMAND")
    args.add_argument("directory")
    for name, kind in (("path", str), ("line", int), ("col", int), ("symbol", int), ("name", str), ("prefix", str), ("visibility", str), ("language", str), ("least", int), ("most", int), ("limit", int)):
        args.add_argument(f"--{name}", type=kind)
    args.add_argument("--kind", default="")
    args.add_argument("--depth", type=int, default=G.DEEPEST)
    args.add_argument("--top", type=int, default=20)
    args.add_argument("--sort")
    args.add_argument("--order", choices=("asc", "desc"), default="asc")
    args.add_argument("--offset", type=int, default=0)
    args.add_argument("--format", choices=("json", "text"), default="json")
    args.add_argument("--indexed", action="store_true")
    args.add_argument("--force", action="store_true")
    args.add_argument("--out")
    args.add_argument("--languages", default="")
    return args


def answer(facts, got) -> dict:
    """One page of a command's rows, at most 500, in an envelope; a row's error is text, not a trace."""
    try:
        rows = COMMANDS[got.command](facts, got) if got.command in COMMANDS else registry.CATALOG[got.command][0](facts)
        total = rows.count()
        limit, offset = page(got.limit, got.offset)
        columns = set(rows.columns)
        by = [c for c in (SORTS.get(got.sort or "", got.sort), "id") if c in columns]
        if by:
            rows = rows.orderBy(F.desc(by[0]) if got.order == "desc" else F.asc(by[0]), *by[1:])
        found = [json.loads(r.json) for r in rows.offset(offset).limit(limit).select(F.to_json(F.struct("*")).alias("json")).collect()]
        return {"command": got.command, "results": found, "total_count": total, "error": None}
    except ValueError as error:
        return {"command": got.command, "results": [], "total_count": 0, "error": str(error)}


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser()
    got = args.parse_args(words)
    if got.command == "index" and not got.out:
        args.error("index needs --out")
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    if got.command == "index":
        index(spark, got.directory, got.out, tuple(filter(None, got.languages.split(","))), got.force)
        return 0
    told = answer(Indexed(spark, got.directory) if got.indexed else Facts(spark, got.directory), got)
    if got.format == "json":
        print(json.dumps(told))
    else:
        for row in told["results"]:
            print("\t".join(str(x) for x in row.values()))
        print(told["error"] or f"{told['total_count']} rows", file=sys.stderr)
    return 1 if told["error"] else 0


if __name__ == "__main__":
    sys.exit(main())
