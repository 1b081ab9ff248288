"""Oracle SQL of all checks, merged from the per-category modules."""

from __future__ import annotations

import importlib

SQL: dict[str, str] = {}
for _mod in ("schema", "replication", "config", "extensions", "sql_patterns", "functions", "sequences", "dump"):
    try:
        SQL.update(importlib.import_module(f"{__package__}.{_mod}").SQL)
    except ModuleNotFoundError as e:  # category not written yet
        if e.name != f"{__package__}.{_mod}":
            raise
