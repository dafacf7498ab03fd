from __future__ import annotations

from factloom.plans import registry
from factloom.sources.index import index


def test_a_tree_is_indexed_and_queried(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "shop").mkdir(parents=True)
    (tree / "shop" / "cart.go").write_text('package shop\n\ntype Cart struct {\n\tBase\n}\n\nfunc (c *Cart) Price(x int) int {\n\treturn Sum(x)\n}\n')
    (tree / "shop" / "sum.go").write_text("package shop\n\ntype Base struct {\n}\n\ntype Pricer interface {\n\tPrice(x int) int\n}\n\nfunc Sum(x int) int {\n\treturn x\n}\n")
    (tree / "A.java").write_text("package a;\nimport java.util.List;\n@Service\nclass A implements I {\n  int f() { return 1; }\n}\ninterface I { int f(); }\n")
    (tree / "b.py").write_text("def g():\n    return h()\n\n\ndef h():\n    return 1\n")
    facts = index(spark, str(tree), str(tmp_path / "out"))
    names = {r.id: r.name for r in facts.symbols.collect()}
    assert {r.path: r.language for r in facts.files.collect()} == {"shop/cart.go": "go", "shop/sum.go": "go", "A.java": "java", "b.py": "python"}
    assert {(names[r.caller_symbol_id], names[r.callee_symbol_id]) for r in facts.call_graph.collect()} == {("Price", "Sum"), ("g", "h")}
    assert {(names[r.type_symbol_id], names[r.interface_symbol_id], r.kind) for r in facts.implementations.collect()} == {("A", "I", "explicit"), ("Cart", "Pricer", "implicit")}
    assert {(names[r.composite_symbol_id], names[r.component_symbol_id]) for r in facts.type_compositions.collect()} == {("Cart", "Base")}
    assert [(r.name, names[r.target_symbol_id]) for r in facts.annotations.collect()] == [("Service", "A")]
    assert [r.source for r in facts.imports.collect()] == ["java.util.List"]
    for name in ("hotspots", "ref_counts", "unused_symbols", "summary_languages", "innermost_scope", "package_graph_edges", "call_pairs", "impl_pairs", "symbols_list"):
        registry.CATALOG[name][0](facts).collect()
    assert {r.name for r in registry.CATALOG["hotspots"][0](facts).collect()} >= {"Sum", "h"}
    again = index(spark, str(tree), str(tmp_path / "out"), ("python",))
    assert again.files.count() == 1 and again.call_graph.count() == 1
    assert {r.name for r in again.symbols.collect()} == {"g", "h"}


def test_a_tree_without_sources(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "readme.txt").write_text("no\n")
    facts = index(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert facts.files.isEmpty() and facts.symbols.isEmpty() and facts.call_graph.isEmpty()


def test_names_with_underscores_and_dots_are_read(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "pkg" / "_inner").mkdir(parents=True)
    for name in ("pkg/__init__.py", "pkg/_util.py", "pkg/a.py", "pkg/_inner/b.py", "pkg/c d.py"):
        (tree / name).write_text(f"def f{len(name)}():\n    return 1\n")
    facts = index(spark, str(tree), str(tmp_path / "out"))
    assert {r.path for r in facts.files.collect()} == {"pkg/__init__.py", "pkg/_util.py", "pkg/a.py", "pkg/_inner/b.py", "pkg/c d.py"}
    assert facts.symbols.filter("kind = 'function'").count() == 5


def test_only_what_a_change_reaches_is_resolved_again(spark, tmp_path):
    tree, out = tmp_path / "tree", str(tmp_path / "out")
    tree.mkdir()
    (tree / "a.py").write_text("from b import h\n\n\ndef g():\n    return h()\n")
    (tree / "b.py").write_text("def h():\n    return 1\n")
    (tree / "c.py").write_text("def k():\n    return k()\n")
    told = lambda facts: {r.key: r.value for r in facts.table("metadata").collect()}
    calls = lambda facts: sorted((r.caller_symbol_id, r.callee_symbol_id) for r in facts.call_graph.collect())
    first = index(spark, str(tree), out)
    before = calls(first)
    assert told(first)["resolved_files"] == "3" and len(before) == 2
    same = index(spark, str(tree), out)
    assert told(same)["resolved_files"] == "0" and calls(same) == before
    (tree / "b.py").write_text("# more\n\n\ndef h():\n    return 2\n")
    after = index(spark, str(tree), out)
    whole = index(spark, str(tree), str(tmp_path / "anew"))
    assert told(after)["resolved_files"] == "2"
    for name in ("files", "symbols", "references", "resolved_references", "call_graph", "implementations"):
        rows = lambda x: sorted(str(sorted(r.asDict().items(), key=lambda kv: kv[0])) for r in getattr(x, name).collect())  # noqa: B023, E731
        assert rows(after) == rows(whole), name
    (tree / "b.py").unlink()
    gone = index(spark, str(tree), out)
    assert {r.path for r in gone.files.collect()} == {"a.py", "c.py"} and len(calls(gone)) == 1
    assert told(index(spark, str(tree), out, force=True))["resolved_files"] == "2"


def test_commands_take_arguments(spark, tmp_path, capsys):
    import json

    from factloom.__main__ import main

    tree, out = tmp_path / "tree", str(tmp_path / "out")
    tree.mkdir()
    (tree / "b.py").write_text("def g():\n    return h()\n\n\ndef h():\n    return 1\n")
    assert main(["index", str(tree), "--out", out], spark) == 0

    def ask(*words):
        code = main([words[0], out, "--indexed", *words[1:]], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, told = ask("callers", "--name", "h")
    assert code == 0 and told["total_count"] == 1 and told["error"] is None and told["command"] == "callers"
    assert [r["name"] for r in ask("symbol-at", "--path", "b.py", "--line", "5", "--col", "4")[1]["results"]] == ["h"]
    assert [r["name"] for r in ask("symbols", "--kind", "function", "--sort", "name", "--order", "desc", "--limit", "1")[1]["results"]] == ["h"]
    assert {r["name"] for r in ask("transitive-callees", "--name", "g", "--depth", "2")[1]["results"]} == {"g", "h"}
    assert ask("callees", "--name", "none") == (1, {"command": "callees", "results": [], "total_count": 0, "error": "no such symbol"})


def test_headers_are_included_by_name_and_fields_lead_to_their_struct(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "util.h").write_text("struct Box { int width; };\nint area(struct Box *b);\n")
    (tree / "util.c").write_text('#include "util.h"\nint area(struct Box *b) {\n  return b->width;\n}\n')
    (tree / "main.c").write_text('#include "util.h"\nint main(void) {\n  struct Box b;\n  return area(&b);\n}\n')
    facts = index(spark, str(tree), str(tmp_path / "out"))
    path = {r.id: r.path for r in facts.files.collect()}
    symbol = {r.id: r for r in facts.symbols.collect()}
    link = {r.reference_id: symbol[r.target_symbol_id] for r in facts.resolved_references.collect()}
    got = {(path[r.file_id], r.name, link[r.id].name, path[link[r.id].file_id]) for r in facts.references.collect() if r.id in link}
    assert {("main.c", "area", "area", "util.h"), ("util.c", "width", "Box", "util.h")} <= got
    assert {(r.name, r.type_expr) for r in facts.type_members.collect()} == {("width", "int")}
