"""Source trees as DataFrames: discovery, content, hashes, and facts extracted from source files."""

from __future__ import annotations

import ast
import hashlib
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.functions.ids import fact_id
from factloom.sources.lexical import LANGUAGES, LexicalFacts

#: Folders that a walk without git leaves out, beside those that begin with a dot.
LEFT_OUT = ("node_modules", "vendor", "__pycache__")
#: Files that one task reads.
FILES_A_TASK = 1000


def listed(root: str) -> list[str]:
    """Paths of a tree below root: those git knows or does not ignore, else all but some folders."""
    done = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=False)
    if done.returncode == 0:
        return sorted({x for x in done.stdout.decode(errors="replace").split("\0") if x})
    out = []
    for folder, names, files in os.walk(root):
        names[:] = [x for x in names if not x.startswith(".") and x not in LEFT_OUT]
        out += [os.path.relpath(os.path.join(folder, x), root) for x in files]
    return sorted(out)


def source_files(spark: SparkSession, root: str, languages: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), language, content, hash and line_count of the known source files of a tree.

    The driver lists names only; executors open the listed files, so the tree lies where all of them can read it. No other
    file is opened, and names that begin with a dot or underscore are files like others. A file that is gone by then is left out.
    """
    base = os.path.abspath(root)
    known = {x: P.LANGUAGES.get(os.path.splitext(x)[1].lower()) for x in listed(root)}
    names = [(x, y) for x, y in known.items() if y and (not languages or y in languages)]
    schema = "path string, language string, content binary, hash string, line_count int"
    if not names:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                row = (path, language, content, hashlib.sha256(content).hexdigest(), content.count(b"\n") + 1)
                kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["path", "language", "content", "hash", "line_count"])

    tasks = min(len(names), max(spark.sparkContext.defaultParallelism, len(names) // FILES_A_TASK))
    return spark.createDataFrame(names, "path string, language string").repartition(tasks, "path").mapInArrow(read, schema)


FACT = "path string, fact string, id long, name string, kind string, owner long, detail string, start_line int, start_col int, end_line int, end_col int"


class PythonFacts(ast.NodeVisitor):
    """Facts of one Python file as (fact, id, name, kind, owner, detail, span) rows; lines count from 0."""

    def __init__(self, path: str, tree: ast.Module, lines: int):
        self.path, self.rows = path, []
        self.symbols: list[tuple[int | None, str]] = [(None, "module")]
        self.scopes = [fact_id(path, "scope", 0, 0, "module")]
        self.rows.append(("scope", self.scopes[0], "", "module", None, "", 0, 0, lines, 0))
        self.generic_visit(tree)

    def add(self, fact: str, node: ast.AST, name: str, kind: str, owner: int | None, detail: str = "") -> int:
        noted = getattr(node, "decorator_list", []) if fact == "symbol" else []
        start = (noted[0].lineno - 1, max(noted[0].col_offset - 1, 0)) if noted else (node.lineno - 1, node.col_offset)
        span = (*start, (node.end_lineno or node.lineno) - 1, node.end_col_offset or 0)
        key = fact_id(self.path, fact, kind, name, detail if fact != "symbol" else "", *span)
        self.rows.append((fact, key, name, kind, owner, detail, *span))
        return key

    def visible(self, name: str) -> str:
        return "private" if name.startswith("_") else "public"

    def decorators(self, node, key: int) -> list[str]:
        names = []
        for d in node.decorator_list:
            call = d.func if isinstance(d, ast.Call) else d
            names.append(ast.unparse(call))
            self.add("annotation", d, names[-1], "decorator", key, "(" + ", ".join(map(ast.unparse, d.args)) + ")" if isinstance(d, ast.Call) else "")
            self.visit(d)
        return names

    def body_of(self, node, key: int, kind: str) -> None:
        self.symbols.append((key, kind))
        self.scopes.append(self.add("scope", node, "", kind, self.scopes[-1], str(key)))
        for x in node.body:
            self.visit(x)
        self.scopes.pop()
        self.symbols.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        key = self.add("symbol", node, node.name, "class", self.symbols[-1][0], self.visible(node.name))
        self.decorators(node, key)
        for base in node.bases:
            self.add("member", base, ast.unparse(base), "base_class", key, "public:" + ast.unparse(base))
            self.visit(base)
        self.body_of(node, key, "class")

    def visit_FunctionDef(self, node) -> None:
        names = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        inside = self.symbols[-1][1] == "class"
        kind = "function" if not inside else "static_method" if "staticmethod" in names else "class_method" if "classmethod" in names else "property" if "property" in names else "method"
        key = self.add("symbol", node, node.name, kind, self.symbols[-1][0], self.visible(node.name))
        self.decorators(node, key)
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        for k, x in enumerate(every):
            receiver = inside and k == 0 and kind != "static_method"
            self.add("parameter", x, x.arg, "receiver" if receiver else "parameter", key, f"{k}:{ast.unparse(x.annotation) if x.annotation else ''}")
            if x.annotation:
                self.visit(x.annotation)
        if node.returns:
            self.add("parameter", node.returns, "", "return", key, f"0:{ast.unparse(node.returns)}")
            self.visit(node.returns)
        for x in [*a.defaults, *(d for d in a.kw_defaults if d)]:
            self.visit(x)
        self.body_of(node, key, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def assigned(self, target: ast.AST, typed: ast.AST | None = None) -> None:
        owner, kind = self.symbols[-1]
        if isinstance(target, ast.Name):
            if kind == "class":
                self.add("member", target, target.id, "field", owner, self.visible(target.id) + (":" + ast.unparse(typed) if typed else ""))
            else:
                self.add("symbol", target, target.id, "variable", owner, self.visible(target.id))
        elif isinstance(target, ast.Tuple | ast.List):
            for x in target.elts:
                self.assigned(x)
        else:
            self.visit(target)

    def visit_Assign(self, node: ast.Assign) -> None:
        for x in node.targets:
            self.assigned(x)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.assigned(node.target, node.annotation)
        self.visit(node.annotation)
        if node.value:
            self.visit(node.value)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", node, x.name, "module", None, x.asname or "")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        source = "." * node.level + (node.module or "")
        for x in node.names:
            self.add("import", node, source, "wildcard" if x.name == "*" else "name", None, f"{x.name}:{x.asname or ''}")

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.add("reference", node.func, node.func.id, "call", self.scopes[-1])
        else:
            self.visit(node.func)
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(x)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.add("reference", node, node.attr, "field_access", self.scopes[-1])
        self.visit(node.value)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("reference", node, node.id, "type_annotation" if node.id[:1].isupper() else "read", self.scopes[-1])


def facts_of(path: str, content: bytes, language: str) -> list[tuple]:
    """Facts of one file; none if Python does not parse it."""
    if language in LANGUAGES:
        return LexicalFacts(path, content.decode(errors="replace"), language).rows
    try:
        return PythonFacts(path, ast.parse(content), content.count(b"\n") + 1).rows
    except (SyntaxError, ValueError):
        return []


def source_facts(files: DataFrame) -> DataFrame:
    """Facts of every file of ``source_files``, one tagged row each; files are read and parsed one by one on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("fact", pa.string()), ("id", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("owner", pa.int64()), ("detail", pa.string()), *((x, pa.int32()) for x in ("start_line", "start_col", "end_line", "end_col"))])
        for batch in batches:
            for path, content, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = facts_of(path, content, language)
                if rows:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*((path, *r) for r in rows), strict=True), schema, strict=True)], schema=schema)

    return files.filter(F.col("language").isin("python", *LANGUAGES)).select("path", "content", "language").mapInArrow(run, FACT)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of the Python files alone."""
    return source_facts(files.filter("language = 'python'"))
