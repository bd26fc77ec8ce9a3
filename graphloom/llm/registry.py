"""Queries and SQL of all operators of this subpackage."""

from __future__ import annotations

from . import decontaminate, language_id, media_sniff, packing, simhash, site_style_tree, substring_dedup, token_rollup, tool_calls, toxicity

MODULES = [tool_calls, site_style_tree, simhash, packing, media_sniff, language_id, decontaminate, toxicity, token_rollup, substring_dedup]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
