"""Every registered query and its SQL, gathered from the modules of ``colloquy.plans``."""

from __future__ import annotations

from colloquy.plans import conversations, documents, events, scenarios, turns, vectors

_MODULES = (conversations, documents, vectors, events, turns, scenarios)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
