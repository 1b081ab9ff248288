"""DuckDB oracle SQL for every ``queries()`` entry.

Written independently of the Spark code, over the same derived views
(FIXTURES.md section 2, DuckDB dialect).  ``build`` prefixes the fixture views
a body uses as CTEs, then the shared helper CTEs, then the body's own CTEs.
"""

from __future__ import annotations

import re

from ..sources.catalog import EXCLUDED_NAMESPACES, duckdb_view_sql
from ..sources.fixtures_sql import VIEW_SQL

_EXCL = ", ".join(f"'{n}'" for n in EXCLUDED_NAMESPACES)

HELPERS = {
    "ns": f"select instance_id, oid as relnamespace, nspname from cat_namespace where nspname not in ({_EXCL})",
    "uc": ("select c.instance_id, c.oid, c.relnamespace, c.relname, c.relkind, c.relpersistence, "
           "c.relrowsecurity, c.relforcerowsecurity, c.reltablespace, n.nspname, "
           "n.nspname || '.' || c.relname as fqn from cat_class c join ns n "
           "on n.instance_id = c.instance_id and n.relnamespace = c.relnamespace"),
    "cur_stmt": ("select s.* from stat_statements s where s.snapshot_no = "
                 "(select max(m.snapshot_no) from stat_statements m where m.instance_id = s.instance_id)"),
    "inst": "select instance_id from instances",
}
_HELPER_DEPS = {"uc": ["ns"]}


def _words(text: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))


def build(body: str, bigint_instance: bool = True) -> str:
    body = body.strip()
    own = ""
    if body.lower().startswith("with "):
        own = body[5:]
        body_words = _words(body)
    else:
        body_words = _words(body)
    helpers: list[str] = []

    def need_helper(h: str) -> None:
        for d in _HELPER_DEPS.get(h, []):
            need_helper(d)
        if h not in helpers:
            helpers.append(h)

    for h in HELPERS:
        if h in body_words:
            need_helper(h)
    words = set(body_words)
    for h in helpers:
        words |= _words(HELPERS[h])
    views = [v for v in VIEW_SQL if v in words]
    ctes = [f"{v} as ({duckdb_view_sql(v)})" for v in views]
    ctes += [f"{h} as ({HELPERS[h]})" for h in helpers]
    if own:
        sql = "with " + ",\n".join(ctes + [own]) if ctes else "with " + own
    else:
        sql = ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body
    if bigint_instance:
        sql = f"select * replace (cast(instance_id as bigint) as instance_id) from (\n{sql}\n) q"
    return sql


def any_contains(expr: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"contains({expr}, '{p}')" for p in patterns) + ")"


def label_case(expr: str, labels: dict[str, str]) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return f"coalesce(case cast({expr} as varchar) {whens} end, cast({expr} as varchar))"
