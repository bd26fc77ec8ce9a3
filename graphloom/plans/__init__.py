"""Registered queries over the benchmark tables, each with its SQL."""

from . import code, graphs, streams, tables

_MODULES = [tables, graphs, streams, code]
QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
