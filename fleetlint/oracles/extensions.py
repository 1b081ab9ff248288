"""Oracle SQL (DuckDB) for the extension checks."""

from __future__ import annotations

_TYPES = "Adds types or functions that rows depend on: install the same version on every node."
_INDEX = "Adds index operators only; rows replicate as before."
_LOCAL = "Works on this node''s own data or connections: set it up on every node."
_OTHER = "Distributes or replicates data itself and does not work together with Spock."
_ROWS = [(n, _TYPES, False) for n in ("postgis", "pgcrypto", "hstore", "ltree", "citext")]
_ROWS += [(n, _INDEX, False) for n in ("pg_trgm", "btree_gist", "btree_gin")] + [(n, _LOCAL, False) for n in ("dblink", "postgres_fdw", "file_fdw")]
_ROWS += [(n, _OTHER, True) for n in ("timescaledb", "citus")]
_ROWS += [("pg_stat_statements", "Shows statistics of this node only.", False),
          ("pg_partman", "Changes partitions on its own: run its maintenance on one node and replicate the DDL, or on all nodes alike.", False),
          ("lo", "Keeps references to large objects, which logical replication leaves out; LOLOR replicates them.", True)]
_KNOWN = ", ".join(f"('{n}', '{note}', {'true' if warn else 'false'})" for n, note, warn in _ROWS)

SQL = {
    "installed_extensions": f"""
with ie as (select * from cat_extension where installed),
pi as (select i.instance_id, coalesce(c.n, 0) as extension_count, coalesce(c.l, '') as extensions
       from instances i left join (
         select instance_id, count(*) as n,
                string_agg(extname || ' (' || extversion || ')', ', ' order by extname) as l
         from ie group by instance_id) c on c.instance_id = i.instance_id),
known(extname, note, warn) as (values {_KNOWN})
select x.instance_id, x.extname as object_name, case when k.warn then 'WARNING' else 'INFO' end as severity,
       x.extversion as version, k.note, p.extension_count, cast(null as varchar) as extensions
from ie x join known k on k.extname = x.extname join pi p on p.instance_id = x.instance_id
union all
select instance_id, '(extensions)', 'CONSIDER', null, null, extension_count, extensions from pi""",

    "extension_versions": """
select instance_id, extname as object_name, 'CONSIDER' as severity, extversion as installed_version,
       default_version as available_version
from cat_extension where installed and extversion <> default_version""",

    "snowflake_ext": """
with sf as (select instance_id, max(case when installed then extversion end) as iv, max(default_version) as av
            from cat_extension where extname = 'snowflake' group by instance_id)
select i.instance_id, 'snowflake' as object_name,
       case when sf.iv is null and sf.av is not null then 'CONSIDER' else 'INFO' end as severity,
       case when sf.iv is not null then 'installed' when sf.av is not null then 'available' else 'unavailable' end
         as status,
       coalesce(sf.iv, sf.av) as version
from instances i left join sf on sf.instance_id = i.instance_id""",

    "pg_stat_statements_check": """
with e as (select instance_id, extversion from cat_extension where installed and extname = 'pg_stat_statements'),
c as (select instance_id, count(*) as n from cur_stmt group by instance_id)
select i.instance_id, 'pg_stat_statements' as object_name,
       case when e.extversion is null then 'CONSIDER' when c.n is null then 'WARNING' else 'INFO' end as severity,
       case when e.extversion is null then 'missing' when c.n is null then 'unreadable' else 'present' end as status,
       case when e.extversion is null then 0 else coalesce(c.n, 0) end as statement_count
from instances i left join e on e.instance_id = i.instance_id left join c on c.instance_id = i.instance_id""",

    "lolor_check": """
with lob as (
  select i.instance_id,
         (select count(*) from cat_largeobject l where l.instance_id = i.instance_id) as lob_count,
         (select count(*) from cat_attribute a join uc u on u.instance_id = a.instance_id and u.oid = a.attrelid
          where u.relkind = 'r' and a.attnum > 0 and a.atttype = 'oid' and a.instance_id = i.instance_id)
           as oid_col_count
  from instances i),
t as (select l.*, e.extversion as v, s.setting as node from lob l
      left join (select instance_id, extversion from cat_extension where installed and extname = 'lolor') e
        on e.instance_id = l.instance_id
      left join (select instance_id, setting from settings where name = 'lolor.node') s
        on s.instance_id = l.instance_id
      where lob_count > 0 or oid_col_count > 0),
t2 as (select *, case when v is null then 'not_installed'
                      when node is null or node in ('', '0') then 'node_unset'
                      when try_cast(node as bigint) is null or try_cast(node as bigint) < 1
                           or try_cast(node as bigint) > 268435456 then 'node_invalid'
                      else 'ok' end as status from t)
select instance_id, case when status in ('node_unset', 'node_invalid') then 'lolor.node' else 'lolor' end
         as object_name,
       case when status = 'ok' then 'INFO' else 'WARNING' end as severity,
       status, lob_count, oid_col_count, node
from t2""",
}
