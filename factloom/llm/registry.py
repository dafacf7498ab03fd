"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "secret_scan", "license_scan", "gif_media", "orc_tokens", "packing", "near_dup", "toxicity", "lm_score", "sentence_pieces")


def queries() -> dict:
    found = {}
    for name in MODULES:
        module = import_module(f"factloom.llm.{name}")
        found[module.NAME] = module.query
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        module = import_module(f"factloom.llm.{name}")
        if getattr(module, "SQL", None):
            found[module.NAME] = module.SQL
    return found
