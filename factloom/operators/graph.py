"""Walks over the call graph and cycles of the package graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.metrics import symbol_rows
from factloom.functions.patterns import last_segment
from factloom.operators.discovery import PACKAGE_KINDS

DEEPEST = 100
_own_dir: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a table in the shared folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="factloom-"))
            atexit.register(shutil.rmtree, _own_dir[0], True)
        base = f"file://{_own_dir[0]}"
    path = f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: Spark judges by compressed files, and symbols or scopes of a few MB there can be too large for the driver."""
    return df.hint("merge")


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """id and smallest depth of nodes within so many steps; edges: source, target; roots: id. Edges already seen are pruned by anti-join."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    seen = cut(roots.select("id", F.lit(0).alias("depth")).distinct())
    front = seen
    steps = edges.select("source", "target").distinct()
    for k in range(1, min(depth, DEEPEST) + 1):
        found = steps.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        front = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if k % 8 == 0 else seen.unionByName(front)
    return seen


def transitive(facts, symbol_id: int, depth: int, towards: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (with depth) and all edges between them of the callers' or callees' graph of a symbol."""
    calls = facts.call_graph
    source, target = ("callee", "caller") if towards == "callers" else ("caller", "callee")
    edges = calls.select(F.col(f"{source}_symbol_id").alias("source"), F.col(f"{target}_symbol_id").alias("target"))
    roots = facts.symbols.filter(F.col("id") == symbol_id).select("id")
    nodes = walk(edges, roots, depth)
    ids = nodes.select("id")
    inside = calls.join(ids.withColumnRenamed("id", "caller_symbol_id"), "caller_symbol_id", "left_semi").join(ids.withColumnRenamed("id", "callee_symbol_id"), "callee_symbol_id", "left_semi")
    rows = symbol_rows(facts, facts.symbols.join(ids, "id", "left_semi")).join(nodes, "id")
    return rows, inside.select("id", "caller_symbol_id", "callee_symbol_id", "file_id", "line", "col")


def package_of_file(facts) -> DataFrame:
    """file_id, package: of a file's package symbols the last."""
    rows = facts.symbols.filter(F.col("kind").isin(*PACKAGE_KINDS) & F.col("file_id").isNotNull())
    return rows.groupBy("file_id").agg(F.max_by("name", "id").alias("package"))


def package_nodes(facts) -> DataFrame:
    """Packages with files and lines."""
    files = facts.files.select(F.col("id").alias("file_id"), "line_count")
    rows = package_of_file(facts).join(files, "file_id")
    return rows.groupBy("package").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("line_count"))


def package_edges(facts) -> DataFrame:
    """from_package, to_package, import_count. A source names a package exactly, or by its last segment, or ends a file's path."""
    own = package_of_file(facts)
    names = own.select(F.col("package").alias("to_package")).distinct()
    sources = facts.imports.select("source").distinct()
    exact = sources.join(names, sources.source == names.to_package).select("source", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("file_id"), "to_package")
    tail = sources.withColumn("last", last_segment(F.col("source")))
    second = tail.join(names, tail.last == names.to_package).select("source", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("file_id"), "to_package")
    parts = F.split("path", "/")
    # Every suffix of a path at a slash, so that "ends in" becomes an equality.
    suffixes = facts.files.select(F.col("id").alias("file_id"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("source"))
    third = sources.join(suffixes, "source").join(own, "file_id").select("source", F.lit(3).alias("tier"), "file_id", F.col("package").alias("to_package"))
    best = exact.unionByName(second).unionByName(third).groupBy("source").agg(F.min_by("to_package", F.struct("tier", "file_id")).alias("to_package"))
    hits = facts.imports.select("file_id", "source").join(best, "source").join(own.withColumnRenamed("package", "from_package"), "file_id")
    return hits.groupBy("from_package", "to_package").agg(F.count("*").alias("import_count"))


def ranked(edges: DataFrame) -> DataFrame:
    """Package edges with nth, their place in a total order: most imports first, then by name. One row per package pair."""
    return edges.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("import_count"), "from_package", "to_package")))


def cycles(edges: DataFrame) -> DataFrame:
    """members, one row per strongly connected part of more than one package, or with a self-loop: names joined by >, the first again at the end.

    edges: from_package, to_package. Reachability is doubled until it no longer grows.
    """
    step = edges.select(F.col("from_package").alias("a"), F.col("to_package").alias("b")).distinct()
    reach, size = cut(step), None
    while True:
        longer = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        reach = cut(reach.unionByName(longer).distinct())
        now = reach.count()
        if now == size:
            break
        size = now
    both = reach.alias("x").join(reach.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select("x.a", "x.b")
    parts = both.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("members")).select("members").distinct()
    whole = F.concat(F.col("members"), F.slice("members", 1, 1))
    return parts.select(F.array_join(whole, ">").alias("cycle"), F.size("members").cast("long").alias("size"))


def cycles_in_walk_order(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected parts in the order of a depth-first walk from roots by name; for the package graph, which is small."""
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, inside, out = [], set(), []
    for root in sorted(ahead):
        if root in index:
            continue
        work = [(root, iter(ahead[root]))]
        index[root] = low[root] = len(index)
        open_.append(root)
        inside.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    open_.append(other)
                    inside.add(other)
                    work.append((other, iter(ahead[other])))
                    break
                if other in inside:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while part[-1:] != [node]:
                        part.append(open_.pop())
                        inside.discard(part[-1])
                    part.reverse()
                    if len(part) > 1 or node in ahead[node]:
                        out.append([*part, part[0]])
    return sorted(out, key=lambda x: x[0])
