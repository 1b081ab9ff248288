"""Oracle SQL (DuckDB) for the function, trigger and view checks."""

from __future__ import annotations

from . import label_case

# Values of the oracle's own.
AUDITED_LANGUAGES = ["plpgsql", "sql", "plpython3u", "plperl", "plv8"]
PROKIND_LABELS = {"f": "function", "p": "procedure", "a": "aggregate", "w": "window"}
VOLATILITY_LABELS = {"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}
WRITE_PATTERNS = ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "CREATE ", "ALTER ", "DROP ", "EXECUTE ", "PERFORM "]

_LANGS = ", ".join(f"'{x}'" for x in AUDITED_LANGUAGES)
_WRITES = ", ".join(f"case when contains(upper(prosrc), '{p}') then '{p.strip()}' end" for p in WRITE_PATTERNS)
_EV = [("INSERT", 4), ("DELETE", 8), ("UPDATE", 16), ("TRUNCATE", 32)]
_EVENTS = ", ".join(f"case when t.tgtype & {b} > 0 then '{n}' end" for n, b in _EV)

SQL = {
    "stored_procedures": f"""
with p as (select p.*, n.nspname from cat_proc p join ns n on n.instance_id = p.instance_id
           and n.relnamespace = p.pronamespace where p.lanname in ({_LANGS})),
tot as (select instance_id, count(*) as total_count from p group by instance_id),
w as (select p.*, concat_ws(',', {_WRITES}) as writes from p)
select w.instance_id, w.nspname || '.' || w.proname as object_name, 'CONSIDER' as severity,
       {label_case('w.prokind', PROKIND_LABELS)} as kind, w.lanname as language,
       {label_case('w.provolatile', VOLATILITY_LABELS)} as volatility, w.writes, t.total_count
from w join tot t on t.instance_id = w.instance_id where w.writes <> ''
union all
select instance_id, '(functions)', 'INFO', null, null, null, null, total_count from tot""",

    "trigger_functions": f"""
select t.instance_id, u.fqn || '.' || t.tgname as object_name,
       case when t.tgenabled in ('A', 'R') then 'WARNING' else 'INFO' end as severity,
       case t.tgtype & 66 when 2 then 'BEFORE' when 64 then 'INSTEAD OF' else 'AFTER' end as timing,
       case when t.tgtype & 4 > 0 then 'INSERT' when t.tgtype & 8 > 0 then 'DELETE'
            when t.tgtype & 16 > 0 then 'UPDATE' when t.tgtype & 32 > 0 then 'TRUNCATE' else 'UNKNOWN' end as event,
       concat_ws(',', {_EVENTS}) as events,
       pn.nspname || '.' || p.proname as function, t.tgenabled as enabled
from cat_trigger t
join uc u on u.instance_id = t.instance_id and u.oid = t.tgrelid
join cat_proc p on p.instance_id = t.instance_id and p.oid = t.tgfoid
join cat_namespace pn on pn.instance_id = p.instance_id and pn.oid = p.pronamespace
where not t.tgisinternal""",

    "views_audit": """
with v as (select * from uc where relkind in ('v', 'm')),
tot as (select instance_id, count(*) as view_count, count(*) filter (where relkind = 'm') as materialized_count
        from v group by instance_id)
select v.instance_id, v.fqn as object_name, 'CONSIDER' as severity, 'materialized' as kind,
       cast(null as varchar) as trigger_name, t.view_count, t.materialized_count
from v join tot t on t.instance_id = v.instance_id where v.relkind = 'm'
union all
select v.instance_id, v.fqn, 'CONSIDER', 'instead_of_trigger', tr.tgname, t.view_count, t.materialized_count
from v join cat_trigger tr on tr.instance_id = v.instance_id and tr.tgrelid = v.oid
join tot t on t.instance_id = v.instance_id
where v.relkind = 'v' and tr.tgtype & 64 > 0
union all
select instance_id, '(views)', 'INFO', 'total', null, view_count, materialized_count from tot""",
}
