"""Oracle SQL (DuckDB) for the SQL-pattern checks."""

from __future__ import annotations

# every CREATE, ALTER or DROP of these object kinds counts as DDL, but for the three that cannot be matched
_KINDS = ["TABLE", "INDEX", "VIEW", "FUNCTION", "PROCEDURE", "TRIGGER", "TYPE", "SCHEMA", "SEQUENCE"]
_NOT = {"ALTER INDEX", "ALTER TRIGGER", "ALTER SCHEMA"}
DDL_RX = "(?is)" + "|".join(f"{verb} {kind}" for kind in _KINDS for verb in ("CREATE", "ALTER", "DROP") if f"{verb} {kind}" not in _NOT)


def _examples(rx: str, chars: int, sev: str) -> str:
    return f"""
with m as (select instance_id, query, calls,
                  row_number() over (partition by instance_id order by calls desc, query) as rn
           from cur_stmt where regexp_matches(query, '{rx}'))
select instance_id, '(queries)' as object_name, '{sev}' as severity, count(*) as pattern_count,
       string_agg(case when rn <= 10 then '[' || cast(calls as varchar) || ' calls] ' || substr(query, 1, {chars}) end,
                  chr(10) order by rn) as examples
from m group by instance_id"""


_PATTERNS = [("truncate_cascade", r"(?is)TRUNCATE.*CASCADE"), ("truncate_restart", r"(?is)TRUNCATE.*RESTART"), ("ddl", DDL_RX),
             ("advisory_lock", r"(?is)pg_advisory_lock|pg_try_advisory_lock"),
             ("concurrent_index", r"(?is)CREATE\s+INDEX\s+CONCURRENTLY"), ("temp_table", r"(?is)CREATE\s+(TEMP|TEMPORARY)\s+TABLE")]

SQL = {
    "pattern_statements": "\nunion all\n".join(
        f"select instance_id, '{name}' as pattern, cast(calls as bigint) as calls, query from cur_stmt where regexp_matches(query, '{rx}')"
        for name, rx in _PATTERNS),
    "truncate_cascade": r"""
select instance_id, '(query)' as object_name, 'WARNING' as severity, 'cascade' as pattern,
       query as query, calls
from cur_stmt where regexp_matches(query, '(?is)TRUNCATE.*CASCADE')
union all
select instance_id, '(query)', 'CONSIDER', 'restart', query, calls
from cur_stmt where regexp_matches(query, '(?is)TRUNCATE.*RESTART')
union all
select instance_id, 'pg_stat_statements', 'INFO', 'no_statistics', null, 0
from instances i where not exists (select 1 from stat_statements s where s.instance_id = i.instance_id)""",
    "ddl_statements": _examples(DDL_RX, 120, "CONSIDER"),
    "advisory_locks": r"""
select instance_id, '(query)' as object_name, 'CONSIDER' as severity, query as query, calls
from cur_stmt where regexp_matches(query, '(?is)pg_advisory_lock|pg_try_advisory_lock')""",
    "concurrent_indexes": _examples(r"(?is)CREATE\s+INDEX\s+CONCURRENTLY", 150, "WARNING"),
    "temp_table_queries": _examples(r"(?is)CREATE\s+(TEMP|TEMPORARY)\s+TABLE", 150, "INFO"),
}
