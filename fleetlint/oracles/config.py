"""Oracle SQL (DuckDB) for the config checks."""

from __future__ import annotations

# Values of the oracle's own.
SPOCK_GUCS = [
    ("spock.conflict_resolution", "last_update_wins", "WARNING"),
    ("spock.save_resolutions", "on", "INFO"),
    ("spock.enable_ddl_replication", "on", "WARNING"),
    ("spock.include_ddl_repset", "on", "INFO"),
    ("spock.allow_ddl_from_functions", "on", "INFO"),
]

_GUCS = ", ".join(f"('{n}', '{r}', '{s}')" for n, r, s in SPOCK_GUCS)
_VN = "(select instance_id, try_cast(setting as bigint) as vn from settings where name = 'server_version_num')"

SQL = {
    "pg_version": f"""
select instance_id, 'pg_version' as object_name,
       case when vn // 10000 in (15, 16, 17, 18) then 'INFO' else 'CRITICAL' end as severity,
       vn // 10000 as major, vn as version_num
from {_VN} v where vn is not null""",

    "pg_minor_version": f"""
with v as (select s.instance_id, i.cluster_id,
                  cast(vn // 10000 as varchar) || '.' || cast(vn % 10000 as varchar) as server_version
           from {_VN} s left join instances i on i.instance_id = s.instance_id where vn is not null),
c as (select coalesce('c' || cluster_id, 'i' || instance_id) as ck, count(distinct server_version) as cluster_versions from v group by 1)
select v.instance_id, 'pg_version' as object_name, 'CONSIDER' as severity, v.server_version, v.cluster_id,
       c.cluster_versions
from v join c on c.ck = coalesce('c' || v.cluster_id, 'i' || v.instance_id)""",

    "track_commit_timestamp": """
select instance_id, name as object_name, 'CRITICAL' as severity, setting as current
from settings where name = 'track_commit_timestamp' and setting <> 'on'""",

    "parallel_apply": """
select instance_id, name as object_name,
       case name when 'max_logical_replication_workers' then 'WARNING' else 'CONSIDER' end as severity,
       setting as current, cast(null as varchar) as max_worker_processes, cast(null as varchar) as max_parallel_workers,
       cast(null as varchar) as max_logical_replication_workers,
       cast(null as varchar) as max_sync_workers_per_subscription
from settings
where (name = 'max_logical_replication_workers' and try_cast(setting as bigint) < 4)
   or (name = 'max_sync_workers_per_subscription' and try_cast(setting as bigint) < 2)
union all
select i.instance_id, '(config)', 'CONSIDER', cast(null as varchar),
       max(case when s.name = 'max_worker_processes' then s.setting end),
       max(case when s.name = 'max_parallel_workers' then s.setting end),
       max(case when s.name = 'max_logical_replication_workers' then s.setting end),
       max(case when s.name = 'max_sync_workers_per_subscription' then s.setting end)
from instances i left join settings s on s.instance_id = i.instance_id
group by i.instance_id""",

    "shared_preload_libraries": """
with l as (select instance_id,
                  list_filter(list_transform(string_split(setting, ','), lambda x: trim(x)), lambda x: x <> '') as libs
           from settings where name = 'shared_preload_libraries')
select instance_id, 'shared_preload_libraries' as object_name, 'CRITICAL' as severity,
       array_to_string(libs, ',') as current_libs
from l where not list_contains(libs, 'spock')""",

    "spock_gucs": f"""
with r(name, recommended, rule_sev) as (values {_GUCS}),
g as (select i.instance_id, r.name, r.recommended, r.rule_sev from instances i, r)
select g.instance_id, g.name as object_name,
       case when s.setting is not null and s.setting <> g.recommended then g.rule_sev else 'INFO' end as severity,
       s.setting as current, g.recommended,
       case when s.setting is null then 'missing' when s.setting <> g.recommended then 'mismatch' else 'ok' end
         as status
from g left join settings s on s.instance_id = g.instance_id and s.name = g.name""",

    "timezone_config": """
select instance_id, name as object_name, 'CONSIDER' as severity, setting as current
from settings where name in ('timezone', 'log_timezone') and setting <> 'UTC'
union all
select instance_id, 'timezone', 'INFO', 'UTC' from settings where name in ('timezone', 'log_timezone')
group by instance_id
having count(*) filter (where name = 'timezone' and setting = 'UTC') > 0
   and count(*) filter (where name = 'log_timezone' and setting = 'UTC') > 0""",

    "idle_transaction_timeout": """
select instance_id, name as object_name, 'CONSIDER' as severity, setting as current
from settings where name in ('idle_in_transaction_session_timeout', 'idle_session_timeout') and setting = '0'""",
}
