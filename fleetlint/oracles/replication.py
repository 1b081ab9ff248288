"""Oracle SQL (DuckDB) for the replication checks."""

from __future__ import annotations


def _lsn(x: str) -> str:
    return (f"(cast(cast('0x' || split_part({x}, '/', 1) as ubigint) as hugeint) * 4294967296 + "
            f"cast(cast('0x' || split_part({x}, '/', 2) as ubigint) as hugeint))")


def _setting(name: str, cond: str, sev: str, extra: str = "") -> str:
    return (f"select s.instance_id, s.name as object_name, '{sev}' as severity, s.setting as current, "
            f"{cond[1]} as required{extra} from settings s where s.name = '{name}' and {cond[0]}")


_SPOCK = "sp as (select distinct instance_id from cat_namespace where nspname = 'spock')"


def _rollup(table: str, cols: list[str], ts: str, row_sev: str, total_sev: str, obj: str,
            extra: list[tuple[str, str]]) -> str:
    gcols = ", ".join(cols)
    order = ", ".join(cols)
    extra_sel = ", ".join(f"{expr} as {name}" for name, expr in extra)
    extra_null = ", ".join(f"cast(null as varchar) as {name}" for name, _ in extra)
    return f"""
with g as (select instance_id, {gcols}, count(*) as n, max({ts}) as last_ts from {table}
           group by instance_id, {gcols}),
tot as (select instance_id, cast(sum(n) as bigint) as total from g group by instance_id),
top as (select *, row_number() over (partition by instance_id order by n desc, {order}) as rnk from g),
pinst as (select i.instance_id, coalesce(t.total, 0) as total
         from instances i left join tot t on t.instance_id = i.instance_id)
select t.instance_id, t.table_name as object_name, '{row_sev}' as severity, 'group' as kind, {extra_sel},
       t.n as event_count, strftime(t.last_ts, '%Y-%m-%d %H:%M:%S') as last_event, t.rnk as rank,
       i.total
from top t join pinst i on i.instance_id = t.instance_id
union all
select instance_id, '{obj}', case when total > 0 then '{total_sev}' else 'INFO' end,
       case when total > 0 then 'total' else 'none' end, {extra_null}, total, cast(null as varchar),
       cast(0 as bigint), total
from pinst"""


SQL = {
    "wal_level": _setting("wal_level", ("s.setting <> 'logical'", "'logical'"), "CRITICAL"),
    "max_replication_slots": _setting(
        "max_replication_slots", ("try_cast(s.setting as bigint) < 10", "'10'"), "WARNING",
        ", (select count(*) from replication_slots r where r.instance_id = s.instance_id) as used_slots"),
    "max_wal_senders": _setting(
        "max_wal_senders", ("try_cast(s.setting as bigint) < 10", "'10'"), "WARNING",
        ", (select count(*) from replication_slots r where r.instance_id = s.instance_id and r.active)"
        " as active_slots"),
    "max_worker_processes": _setting(
        "max_worker_processes", ("try_cast(s.setting as bigint) < 16", "'16'"), "WARNING"),

    "database_encoding": """
with db as (select d.*, i.cluster_id from cat_database d left join instances i on i.instance_id = d.instance_id
            where not d.datistemplate),
pc as (select coalesce('c' || cluster_id, 'i' || instance_id) as ck, count(distinct encoding) as cluster_encodings from db group by 1)
select db.instance_id, db.datname as object_name,
       case when db.encoding <> 'UTF8' then 'CONSIDER' else 'INFO' end as severity,
       db.encoding, db.cluster_id, pc.cluster_encodings
from db join pc on pc.ck = coalesce('c' || db.cluster_id, 'i' || db.instance_id)""",

    "multiple_databases": """
select instance_id, '(instance)' as object_name, 'WARNING' as severity, count(*) as database_count,
       string_agg(datname, ', ' order by datname) as databases
from cat_database where not datistemplate and datname <> 'postgres'
group by instance_id having count(*) > 1""",

    "hba_config": """
with a as (select instance_id, count(*) filter (where list_contains(databases, 'replication')) as re,
                  count(*) as rules from hba_rules group by instance_id)
select i.instance_id, 'pg_hba.conf' as object_name,
       case when a.rules is not null and a.re = 0 then 'WARNING' else 'CONSIDER' end as severity,
       case when a.rules is null then 'unreadable' when a.re = 0 then 'missing' else 'ok' end as status,
       coalesce(a.re, 0) as replication_entries
from instances i left join a on a.instance_id = i.instance_id""",

    "repset_membership": f"""
with {_SPOCK}
select u.instance_id, u.fqn as object_name, 'WARNING' as severity from uc u
where u.relkind = 'r' and u.instance_id in (select instance_id from sp)
  and not exists (select 1 from repset_table r where r.instance_id = u.instance_id and r.set_reloid = u.oid)
union all
select instance_id, 'spock', 'INFO' from instances where instance_id not in (select instance_id from sp)""",

    "subscription_health": f"""
with {_SPOCK},
subs as (select * from subscriptions where instance_id in (select instance_id from sp))
select instance_id, sub_name as object_name, 'CRITICAL' as severity, 'disabled' as kind, sub_name as subscription
from subs where not sub_enabled
union all
select s.instance_id, s.sub_slot_name, 'WARNING', 'slot_inactive', s.sub_name
from subs s join replication_slots r on r.instance_id = s.instance_id and r.slot_name = s.sub_slot_name
where not r.active
union all
select instance_id, 'spock.subscription', 'INFO', 'none', cast(null as varchar) from sp
where instance_id not in (select instance_id from subs)
union all
select instance_id, 'spock', 'INFO', 'no_spock', cast(null as varchar) from instances
where instance_id not in (select instance_id from sp)""",

    "stale_replication_slots": f"""
select instance_id, slot_name as object_name,
       case when mb > 1024 then 'CRITICAL' when mb > 100 then 'WARNING' else 'CONSIDER' end as severity,
       slot_type, restart_lsn, mb as retained_mb
from (select *, coalesce(cast({_lsn('current_lsn')} - {_lsn('restart_lsn')} as double) / 1048576.0, 0.0) as mb
      from replication_slots where not active) x""",

    "conflict_log": _rollup("conflict_history", ["table_name", "conflict_type", "resolution"], "conflict_ts",
                            "WARNING", "WARNING", "spock.conflict_history",
                            [("conflict_type", "t.conflict_type"), ("resolution", "t.resolution")]),
    "exception_log": _rollup("exception_log", ["remote_origin", "table_name", "error_message"], "exception_time",
                             "CRITICAL", "CRITICAL", "spock.exception_log",
                             [("origin", "cast(t.remote_origin as varchar)"),
                              ("error_message", "t.error_message")]),
}
