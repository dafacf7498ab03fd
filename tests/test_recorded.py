"""Source trees with recorded answers, if RECORDED_ANSWERS names a folder of them.

Below it lie ``<language>/level-<nn>-<name>/src`` and a ``golden.json`` of rows that must be found; others may be. Trees of one number
are indexed together, as no link crosses languages.
"""

from __future__ import annotations

import json
import os
import shutil
from collections import defaultdict
from pathlib import Path

import pytest

from factloom.sources.index import index

ROOT = Path(os.environ.get("RECORDED_ANSWERS") or "/nowhere")
CASES = defaultdict(list)
for found in sorted(ROOT.glob("*/level-*/golden.json")):
    CASES[found.parent.name.split("-")[1]].append(found.parent)


def same(want: dict, row, *names: str) -> bool:
    """Whether a row has what is wanted, where it is."""
    return all(want.get(x, "") == "" or want[x] == row[x] for x in names)


@pytest.mark.parametrize("number", sorted(CASES) or [pytest.param("", marks=pytest.mark.skip(reason="RECORDED_ANSWERS is not set"))])
def test_recorded_answers(number, spark, tmp_path):
    for case in CASES[number]:
        shutil.copytree(case / "src", tmp_path / "tree" / case.parent.name)
    facts = index(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    files = {r.id: r.path for r in facts.files.collect()}
    symbols = {r.id: r for r in facts.symbols.collect()}
    imports, members, parameters, generics, references = (getattr(facts, x).collect() for x in ("imports", "type_members", "function_parameters", "type_parameters", "references"))
    links = defaultdict(list)
    for r in facts.resolved_references.collect():
        links[r.reference_id].append(symbols[r.target_symbol_id])
    calls = [(symbols[r.caller_symbol_id], symbols[r.callee_symbol_id]) for r in facts.call_graph.collect()]
    faces = [(symbols[r.type_symbol_id], symbols[r.interface_symbol_id]) for r in facts.implementations.collect()]
    missing = []
    for case in CASES[number]:
        language, gold = case.parent.name, json.loads((case / "golden.json").read_text())
        home = {k for k, x in files.items() if x.startswith(f"{language}/")}
        path = lambda file_id: files[file_id].partition("/")[2]

        def need(what, rows, holds):
            missing.extend((language, what, x) for x in gold.get(what, []) if not any(holds(x, r) for r in rows))  # noqa: B023

        mine = [s for s in symbols.values() if s.file_id in home]
        of = lambda x, r: r.symbol_id in symbols and symbols[r.symbol_id].file_id in home and symbols[r.symbol_id].name == x["parent"]  # noqa: B023, E731
        need("definitions", mine, lambda x, s: (x["name"], x["kind"], x["file"], x["line"]) == (s.name, s.kind, path(s.file_id), s.start_line))
        need("imports", [r for r in imports if r.file_id in home], lambda x, r: x["file"] == path(r.file_id) and same(x, r, "source", "kind"))
        need("type_members", members, lambda x, r: of(x, r) and same(x, r, "name", "kind", "type_expr", "visibility"))
        need("function_params", parameters, lambda x, r: of(x, r) and same(x, r, "ordinal", "name", "type_expr") and (r.is_receiver, r.is_return) == (x.get("is_receiver", False), x.get("is_return", False)))
        need("type_params", generics, lambda x, r: of(x, r) and same(x, r, "name", "ordinal", "constraints"))
        need("implementations", faces, lambda x, r: r[0].file_id in home and (x["type"], x["interface"]) == (r[0].name, r[1].name))
        need("calls", calls, lambda x, r: r[0].file_id in home and (x["caller"], x["callee"]) == (r[0].name, r[1].name))
        at = lambda x, r: path(r.file_id) == x["file"] and (r.start_line, r.start_col) <= (x["line"], x["col"]) <= (r.end_line, r.end_col)
        to = lambda x, s: (x["name"], x["file"], x["line"]) == (s.name, path(s.file_id), s.start_line)
        need("references", [r for r in references if r.file_id in home], lambda x, r: at(x["from"], r) and any(to(x["to"], s) for s in links[r.id]))
    assert not missing
