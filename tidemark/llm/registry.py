"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filter", "quality", "mixing", "neighbours", "packing", "pii", "rules", "near_dedup", "chat", "sharding", "whitening", "html_text", "fill_middle")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"tidemark.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
