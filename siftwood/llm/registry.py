"""Queries and SQL of this folder's operators, for __spark_entry__.py."""

from __future__ import annotations

import importlib

MODULES = ("sharding", "decontaminate", "html_text", "chat_format", "quality_rules", "token_files", "toxicity", "jaccard_join", "bpe_automaton", "token_counts")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
