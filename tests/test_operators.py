"""Behaviour of single operators on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import patterns as P
from factloom.operators import discovery, graph, incremental, position, resolve
from factloom.plans.views import Facts
from factloom.sources import files, tables
from factloom.streaming import ingest


@pytest.mark.parametrize(("asked", "got"), [((None, None), (50, 0)), ((-1, -5), (50, 0)), ((0, 3), (0, 3)), ((900, 0), (500, 0)), ((7, 2), (7, 2))])
def test_page(asked, got):
    assert P.page(*asked) == got


def test_patterns():
    assert P.glob("*") is None and P.glob("") is None
    assert P.glob("a_b*%") == "a\\_b%\\%"
    assert P.under("src") == "src/%" and P.under("src/") == "src/%"


def test_like_takes_wildcards_as_text(spark):
    rows = spark.createDataFrame([("a_b",), ("axb",), ("A_B",), ("a%b",)], "name string")
    assert {r.name for r in rows.filter(F.col("name").ilike(P.glob("a_b"))).collect()} == {"a_b", "A_B"}


def test_paths_and_languages(spark):
    rows = spark.createDataFrame([("x/A.PY",), ("a.h",), ("b.hpp",), ("c",), ("d.zip",)], "path string")
    assert [r.l for r in rows.select(P.language(F.col("path")).alias("l")).collect()] == ["python", "c", "cpp", None, None]
    row = rows.select(P.module_source(F.lit("./a/b.tsx")).alias("m"), P.directory(F.lit("a/b/c.py")).alias("d"), P.last_segment(F.lit("a/b")).alias("s"), P.line_count(F.lit("a\nb\n")).alias("n")).first()
    assert (row.m, row.d, row.s, row.n) == ("a/b", "a/b/", "b", 3)


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1)]


@pytest.mark.parametrize(("depth", "want"), [(0, {1: 0}), (1, {1: 0, 2: 1}), (3, {1: 0, 2: 1, 3: 2, 4: 3}), (200, {1: 0, 2: 1, 3: 2, 4: 3, 5: 4})])
def test_walk(spark, depth, want):
    edges = spark.createDataFrame(EDGES, "source long, target long")
    assert {r.id: r.depth for r in graph.walk(edges, spark.createDataFrame([(1,)], "id long"), depth).collect()} == want


def test_walk_refuses_negative_depth_and_finds_nothing_from_nothing(spark):
    edges = spark.createDataFrame(EDGES, "source long, target long")
    with pytest.raises(ValueError):
        graph.walk(edges, edges.select(F.col("source").alias("id")), -1)
    assert graph.walk(edges, spark.createDataFrame([], "id long"), 3).isEmpty()


def test_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("b", "e")]
    found = graph.cycles(spark.createDataFrame(edges, "from_package string, to_package string"))
    assert {r.cycle for r in found.collect()} == {"a>b>a", "c>c"}
    assert graph.cycles_in_walk_order(edges) == [["a", "b", "a"], ["c", "c"]]


def test_hotspots_bounds(spark, small):
    facts = Facts(spark, small)
    assert discovery.hotspots(facts, 0).isEmpty()
    with pytest.raises(ValueError):
        discovery.hotspots(facts, -1)
    assert discovery.top_symbols(facts, 0).isEmpty()


def test_metamorphic(spark, small):
    facts = Facts(spark, small)
    rows = discovery.symbols(facts)
    assert rows.filter("ref_count <> internal_ref_count + external_ref_count").isEmpty()
    assert rows.filter("ref_count > 0").join(discovery.unused(facts).select("id"), "id").isEmpty()


def test_position_beyond_the_text_has_no_symbol(spark, small):
    facts = Facts(spark, small)
    path = facts.files.filter("id = 3").first().path
    lengths = spark.createDataFrame([(3, 725, 5)], "file_id long, line int, length int")
    assert position.symbol_at(facts, path, 725, 10, lengths).isEmpty()
    assert position.symbol_at(facts, "nowhere", 1, 1).isEmpty()


def test_first_candidate_wins_and_null_consumes(spark):
    schema = "reference_id long, pass_no int, tie1 long, tie2 long, target_symbol_id long, confidence double, resolution_kind string"
    rows = spark.createDataFrame([(1, 2, 0, 0, 20, 0.9, "direct"), (1, 1, 1, 0, 11, 1.0, "direct"), (1, 1, 0, 5, 10, 1.0, "direct"), (2, 0, 0, 0, None, 0.0, "import"), (2, 1, 0, 0, 7, 1.0, "direct")], schema)
    won = {r.reference_id: r.target_symbol_id for r in resolve.winners(rows).collect()}
    assert won == {1: 10, 2: None}
    assert [r.reference_id for r in resolve.resolved(resolve.winners(rows)).collect()] == [1]


def test_inherited_methods(spark):
    bases = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 1, 0), (3, 4, 0)], "class_id long, base_id long, ordinal int")
    own = spark.createDataFrame([(2, "f", 20), (3, "f", 30), (3, "g", 31), (4, "h", 40), (1, "g", 11)], "class_id long, name string, method_id long")
    got = {(r.class_id, r.name): r.method_id for r in resolve.inherited(bases, own).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "f"): 20, (1, "g"): 11, (1, "h"): 40}


def test_diff_and_annotations(spark):
    old = spark.createDataFrame([("a", "f", "", "1"), ("b", "f", "", "1"), ("c", "f", "", "1")], "name string, kind string, parent string, signature_hash string")
    new = spark.createDataFrame([("a", "f", "", "1"), ("b", "f", "", "2"), ("d", "f", "", "1")], "name string, kind string, parent string, signature_hash string")
    assert {(r.name, r.status) for r in incremental.symbol_diff(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    notes = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, resolved_symbol_id long")
    kept = incremental.cleared_annotations(notes, spark.createDataFrame([(5,)], "id long"))
    assert {(r.id, r.resolved_symbol_id) for r in kept.collect()} == {(1, None), (2, 6), (3, None)}


def test_sources_and_python_facts(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("a = 1\n")
    (tmp_path / "pkg" / "a.py").write_text("import os as o\nfrom . import b\n\n\n@deco(1)\nclass A(Base):\n    x = 1\n\n    def f(self, y: int = 2) -> str:\n        return g(y).h\n\n\ndef _p():\n    pass\n")
    (tmp_path / "pkg" / "broken.py").write_text("def (\n")
    (tmp_path / "readme.txt").write_text("no\n")
    found = files.source_files(spark, str(tmp_path))
    assert {r.path: r.line_count for r in found.collect()} == {"pkg/a.py": 15, "pkg/broken.py": 2}
    rows = files.python_facts(found).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fact, set()).add((r.name, r.kind))
    assert by["symbol"] == {("A", "class"), ("f", "method"), ("_p", "function")}
    assert by["member"] == {("Base", "base_class"), ("x", "field")}
    assert by["import"] == {("os", "module"), (".", "name")}
    assert {("self", "receiver"), ("y", "parameter"), ("", "return")} == by["parameter"]
    assert ("g", "call") in by["reference"] and ("h", "field_access") in by["reference"]
    assert len({r.id for r in rows}) == len(rows)


def test_metadata_and_json(spark, tmp_path):
    path = str(tmp_path / "meta")
    for value in ("1", "2"):
        tables.put_metadata(spark, path, "rules", value)
    assert [(r.key, r.value) for r in tables.get_metadata(spark, path).collect()] == [("rules", "2")]
    row = tables.as_json(spark.createDataFrame([(1, "x")], "id long, name string"), "search", 9).first()
    assert json.loads(row.json) == {"command": "search", "result": {"id": 1, "name": "x"}, "total_count": 9}


def test_stream_takes_changed_files_once(spark, tmp_path):
    incoming, history, state = (str(tmp_path / x) for x in ("in", "history", "state"))
    (tmp_path / "in").mkdir()

    def put(name, **texts):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"path": p, "text": t}) + "\n" for p, t in texts.items()))
        ingest.follow(spark, incoming, history, state).awaitTermination()

    put("1.json", a="x", b="y")
    put("2.json", a="x", b="z")
    rows = spark.read.parquet(history)
    assert rows.count() == 3
    assert {r.path for r in ingest.latest(rows).collect()} == {"a", "b"}


class Repeated:
    """Facts of a few symbols and scopes; those with id 1 are two, and scopes 5 and 6 lie around each other."""

    def __init__(self, spark):
        span = "start_line int, start_col int, end_line int, end_col int"
        self.files = spark.createDataFrame([(10, "a.py"), (11, "a.py")], "id long, path string")
        self.symbols = spark.createDataFrame([(1, 11, "m", "module", "public", "[]", 0, 0, 0, 9, None), (1, 10, "f", "function", "public", "[]", 2, 0, 4, 9, None)], f"id long, file_id long, name string, kind string, visibility string, modifiers string, {span}, parent_symbol_id long")
        self.references = spark.createDataFrame([(7, 12)], "id long, file_id long")
        self.resolved_references = spark.createDataFrame([(7, 1)], "reference_id long, target_symbol_id long")
        self.scopes = spark.createDataFrame([(1, 10, 0, 0, 9, 0, None), (1, 11, 0, 0, 9, 0, 2), (2, 11, 0, 0, 99, 0, None), (5, 12, 0, 0, 9, 0, 6), (6, 12, 0, 0, 9, 0, 5)], f"id long, file_id long, {span}, parent_scope_id long")


def test_chains_of_repeated_and_circular_scopes(spark):
    """F2 to F5: each scope's own parent counts, and chains of scopes that lie around themselves end."""
    got = sorted((r.start_id, r.depth, r.id) for r in position.chains(Repeated(spark)).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 1, 2), (2, 0, 2), (5, 0, 5), (5, 1, 6), (6, 0, 6), (6, 1, 5)]


def test_scope_of_one_file_among_files_with_one_path(spark):
    """F8"""
    facts = Repeated(spark)
    assert sorted((r.depth, r.id, r.file_id) for r in position.scope_at(facts, 11, 1, 1).collect()) == [(0, 1, 10), (0, 1, 11), (1, 2, 11)]
    assert {r.depth for r in position.scope_at(facts, 10, 1, 1).collect()} == {0}


def test_details_of_symbols_with_one_id(spark):
    """F7 and F9"""
    parts = "array<struct<name: string>>"
    rows = spark.createDataFrame([(1, [("a",), ("b",)], [], [], [])] * 2, f"id long, parameters {parts}, members {parts}, type_parameters {parts}, annotations {parts}")
    assert sorted(tuple(r) for r in position.detail_rows(rows).collect()) == [(1, "parameters", 0, "a"), (1, "parameters", 1, "b")]


def test_ties_of_top_symbols(spark):
    """an id's package comes after its other symbols."""
    assert [(r.id, r.kind, r.external_ref_count) for r in discovery.top_symbols(Repeated(spark), 1).collect()] == [(1, "function", 2)]


def test_symbols_gone_with_an_id_that_stays(spark):
    """F6 and F10"""
    symbols = spark.createDataFrame([(1, 1), (1, 2), (3, 1), (3, 1), (4, None)], "id long, file_id long")
    links = spark.createDataFrame([(k,) for k in (1, 3, 4)], "target_symbol_id long")
    left = incremental.without_links(links, incremental.gone_symbols(symbols, symbols.file_id % 2 == 1))
    assert sorted(r[0] for r in left.collect()) == [1, 4]
    notes = spark.createDataFrame([(8, 3), (9, 4)], "id long, resolved_symbol_id long")
    assert sorted(tuple(r) for r in incremental.cleared_annotations(notes, symbols.filter("file_id = 1")).collect()) == [(8, None), (8, None), (9, 4)]


@pytest.fixture
def looked_for(monkeypatch):
    """Numbers of places around which a scope was looked for, of each call."""
    numbers, plain = [], position.innermost
    monkeypatch.setattr(position, "innermost", lambda places, *a: numbers.append(places.count()) or plain(places, *a))
    return numbers


def test_scopes_are_looked_for_around_calls_only(spark, small, looked_for):
    """F3"""
    facts = Facts(spark, small)
    edges = resolve.call_edges(facts).count()
    assert 0 < edges <= looked_for[0] < facts.references.count()


def test_nearest_callable_of_repeated_and_circular_scopes(spark):
    """one row a scope; the smaller caller counts at one depth, scopes of other symbols do not count."""
    facts = Repeated(spark)
    span = "start_line int, start_col int, end_line int, end_col int"
    facts.symbols = spark.createDataFrame([(20, "function"), (21, "method"), (22, "variable")], "id long, kind string")
    rows = [(1, 22, None), (1, 21, 2), (2, 20, None), (3, 22, 2), (4, None, None), (5, None, 6), (6, 21, 5), (6, 20, 5)]
    facts.scopes = spark.createDataFrame([(k, 12, s, "function", 0, 0, 9, 0, up) for k, s, up in rows], f"id long, file_id long, symbol_id long, kind string, {span}, parent_scope_id long")
    got = sorted((r.scope_id, r.caller_symbol_id) for r in resolve.nearest_callable(facts).collect())
    assert got == [(1, 21), (2, 20), (3, 20), (5, 20), (6, 20)]


def test_scopes_are_looked_for_around_references_with_a_symbol_only(spark, small, looked_for):
    """F4"""
    facts = Facts(spark, small)
    links = resolve.resolved(resolve.winners(resolve.by_scope(facts))).count()
    assert 0 < links <= looked_for[0] < facts.references.count()


def broadcasts(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_scopes_and_symbols_are_never_broadcast(spark, small, monkeypatch):
    """sides that grow with the input are joined by their keys, though Spark takes their compressed files for small."""
    monkeypatch.setattr("factloom.plans.views.SMALL", 0)
    chains = position.ancestors(Facts(spark, small))
    assert "SortMergeJoin" in chains._jdf.queryExecution().executedPlan().toString() and broadcasts(chains) == 0
    assert broadcasts(Facts(spark, small).references) == 0
