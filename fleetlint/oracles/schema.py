"""Oracle SQL (DuckDB) for the schema checks."""

from __future__ import annotations

from . import any_contains, label_case

# Values of the oracle's own.
CONSTRAINT_TYPE_LABELS = {"p": "PRIMARY KEY", "u": "UNIQUE"}
COUNTER_NAME_PATTERNS = ["count", "total", "sum", "balance", "quantity", "qty", "amount", "tally", "counter", "num_", "cnt", "running_", "cumulative", "aggregate", "accrued", "inventory"]
FK_ACTION_LABELS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
GENERATED_LABELS = {"s": "STORED", "v": "VIRTUAL"}
NUMERIC_TYPES = ["integer", "bigint", "smallint", "numeric", "real", "double precision"]
PARTITION_STRATEGY_LABELS = {"r": "RANGE", "l": "LIST", "h": "HASH"}
RELKIND_LABELS = {"r": "table", "i": "index", "m": "materialized view"}
RULE_EVENT_LABELS = {"1": "SELECT", "2": "UPDATE", "3": "INSERT", "4": "DELETE"}
VOLATILE_DEFAULT_PATTERNS = ["now()", "current_timestamp", "current_date", "current_time", "clock_timestamp()", "statement_timestamp()", "transaction_timestamp()", "timeofday()", "random()", "gen_random_uuid()", "uuid_generate_", "pg_current_xact_id()"]

NO_PK = ("not exists (select 1 from cat_constraint k where k.instance_id = u.instance_id "
         "and k.conrelid = u.oid and k.contype = 'p')")
UCOL = ("from cat_attribute a join uc u on u.instance_id = a.instance_id and u.oid = a.attrelid "
        "where u.relkind = 'r'")
_NUM = ", ".join(f"'{t}'" for t in NUMERIC_TYPES)

SQL = {
    "primary_keys": f"""
select u.instance_id, u.fqn as object_name, 'WARNING' as severity from uc u
where u.relkind = 'r' and {NO_PK}""",

    "tables_update_delete_no_pk": f"""
select * from (
  select u.instance_id, u.fqn as object_name,
         case when s.n_tup_upd + s.n_tup_del > 0 then 'CRITICAL' when s.n_tup_ins > 0 then 'INFO' end as severity,
         cast(s.n_tup_ins as bigint) as inserts, cast(s.n_tup_upd as bigint) as updates,
         cast(s.n_tup_del as bigint) as deletes
  from uc u join cat_table_stats s on s.instance_id = u.instance_id and s.relid = u.oid
  where u.relkind = 'r' and {NO_PK}) x
where severity is not null""",

    "deferrable_constraints": f"""
select u.instance_id, u.fqn || '.' || k.conname as object_name,
       case when k.contype = 'p' then 'CRITICAL' else 'WARNING' end as severity,
       {label_case('k.contype', CONSTRAINT_TYPE_LABELS)} as constraint_type,
       case when k.condeferred then 'DEFERRED' else 'IMMEDIATE' end as initially
from cat_constraint k join uc u on u.instance_id = k.instance_id and u.oid = k.conrelid
where k.contype in ('p', 'u') and k.condeferrable""",

    "exclusion_constraints": """
select u.instance_id, u.fqn || '.' || k.conname as object_name, 'WARNING' as severity, u.fqn as table_name
from cat_constraint k join uc u on u.instance_id = k.instance_id and u.oid = k.conrelid
where k.contype = 'x'""",

    "foreign_keys": f"""
with fkr as (
  select k.instance_id, u.fqn, k.conname, rn.nspname || '.' || rc.relname as ref_table,
         k.confdeltype, k.confupdtype, (k.confdeltype = 'c' or k.confupdtype = 'c') as is_cascade
  from cat_constraint k
  join uc u on u.instance_id = k.instance_id and u.oid = k.conrelid
  join cat_class rc on rc.instance_id = k.instance_id and rc.oid = k.confrelid
  join cat_namespace rn on rn.instance_id = rc.instance_id and rn.oid = rc.relnamespace
  where k.contype = 'f'),
tot as (select instance_id, count(*) as fk_count, count(*) filter (where is_cascade) as cascade_count
        from fkr group by instance_id)
select r.instance_id, r.fqn as object_name, 'WARNING' as severity, r.conname as constraint_name, r.ref_table,
       {label_case('r.confdeltype', FK_ACTION_LABELS)} as on_delete,
       {label_case('r.confupdtype', FK_ACTION_LABELS)} as on_update, t.fk_count, t.cascade_count
from fkr r join tot t on t.instance_id = r.instance_id where r.is_cascade
union all
select instance_id, '(database)', 'CONSIDER', null, null, null, null, fk_count, cascade_count from tot""",

    "missing_fk_indexes": """
with fk as (
  select k.instance_id, k.conrelid, k.conname, k.conkey, u.fqn
  from cat_constraint k join uc u on u.instance_id = k.instance_id and u.oid = k.conrelid
  where k.contype = 'f'),
unc as (
  select * from fk where not exists (
    select 1 from cat_index i where i.instance_id = fk.instance_id and i.indrelid = fk.conrelid
      and len(i.indkey) >= len(fk.conkey) and i.indkey[1:len(fk.conkey)] = fk.conkey)),
ex as (select instance_id, conrelid, conname, fqn, unnest(conkey) as attnum,
              generate_subscripts(conkey, 1) as pos from unc)
select e.instance_id, e.fqn as object_name, 'WARNING' as severity, e.conname as constraint_name,
       string_agg(a.attname, ',' order by e.pos) as fk_columns
from ex e join cat_attribute a on a.instance_id = e.instance_id and a.attrelid = e.conrelid and a.attnum = e.attnum
group by e.instance_id, e.conrelid, e.conname, e.fqn""",

    "sequence_pks": """
select u.instance_id, u.fqn as object_name, 'CRITICAL' as severity, a.attname as column_name,
       case when a.attidentity <> '' then 'identity' else 'serial' end as kind
from uc u
join (select instance_id, conrelid, unnest(conkey) as attnum from cat_constraint where contype = 'p') p
  on p.instance_id = u.instance_id and p.conrelid = u.oid
join cat_attribute a on a.instance_id = u.instance_id and a.attrelid = u.oid and a.attnum = p.attnum
where u.relkind = 'r'
  and (coalesce(contains(lower(a.default_expr), 'nextval('), false) or a.attidentity <> '')""",

    "unlogged_tables": """
select instance_id, fqn as object_name, 'WARNING' as severity from uc
where relkind = 'r' and relpersistence = 'u'""",

    "large_objects": f"""
select instance_id, 'pg_largeobject' as object_name, 'WARNING' as severity,
       cast(null as varchar) as column_name, count(*) as lob_count
from cat_largeobject group by instance_id having count(*) > 0
union all
select u.instance_id, u.fqn || '.' || a.attname, 'WARNING', a.attname, cast(0 as bigint)
{UCOL} and a.attnum > 0 and a.atttype = 'oid'""",

    "column_defaults": f"""
select u.instance_id, u.fqn || '.' || a.attname as object_name, 'CONSIDER' as severity,
       a.attname as column_name, a.default_expr
{UCOL} and a.attgenerated = '' and a.default_expr is not null
  and not contains(lower(a.default_expr), 'nextval(')
  and {any_contains('lower(a.default_expr)', VOLATILE_DEFAULT_PATTERNS)}""",

    "numeric_columns": f"""
select u.instance_id, u.fqn || '.' || a.attname as object_name,
       case when a.attnotnull then 'CONSIDER' else 'WARNING' end as severity,
       a.attname as column_name, a.atttype as data_type
{UCOL} and a.attnum > 0
  and trim(regexp_replace(lower(a.atttype), '\\(.*$', '')) in ({_NUM})
  and {any_contains('lower(a.attname)', COUNTER_NAME_PATTERNS)}""",

    "multiple_unique_indexes": """
select u.instance_id, u.fqn as object_name, 'CONSIDER' as severity, count(*) as unique_index_count,
       string_agg(i.indexname, ',' order by i.indexname) as index_names
from cat_index i join uc u on u.instance_id = i.instance_id and u.oid = i.indrelid
where i.indisunique and u.relkind = 'r'
group by u.instance_id, u.oid, u.fqn having count(*) > 1""",

    "enum_types": """
with e as (
  select e.instance_id, n.nspname, e.typname, e.enumlabel, e.enumsortorder,
         row_number() over (partition by e.instance_id, n.nspname, e.typname order by e.enumsortorder) as rn
  from cat_enum e join ns n on n.instance_id = e.instance_id and n.relnamespace = e.typnamespace)
select instance_id, nspname || '.' || typname as object_name, 'CONSIDER' as severity,
       count(*) as label_count,
       string_agg(enumlabel, ',' order by enumsortorder) as labels
from e group by instance_id, nspname, typname""",

    "generated_columns": f"""
select u.instance_id, u.fqn || '.' || a.attname as object_name, 'CONSIDER' as severity,
       a.attname as column_name, {label_case('a.attgenerated', GENERATED_LABELS)} as gen_type,
       a.default_expr as expression
{UCOL} and a.attnum > 0 and a.attgenerated <> ''""",

    "rules": f"""
select u.instance_id, u.fqn || '.' || r.rulename as object_name,
       case when r.is_instead then 'WARNING' else 'CONSIDER' end as severity,
       r.rulename as rule_name, {label_case('r.ev_type', RULE_EVENT_LABELS)} as event, r.is_instead
from cat_rewrite r join uc u on u.instance_id = r.instance_id and u.oid = r.ev_class
where u.relkind = 'r' and r.rulename <> '_RETURN'""",

    "inheritance": """
select i.instance_id, cn.nspname || '.' || cc.relname as object_name, 'WARNING' as severity,
       pn.nspname || '.' || pc.relname as parent_table, cn.nspname || '.' || cc.relname as child_table
from cat_inherits i
join cat_class pc on pc.instance_id = i.instance_id and pc.oid = i.inhparent
join ns pn on pn.instance_id = pc.instance_id and pn.relnamespace = pc.relnamespace
join cat_class cc on cc.instance_id = i.instance_id and cc.oid = i.inhrelid
join cat_namespace cn on cn.instance_id = cc.instance_id and cn.oid = cc.relnamespace
where pc.relkind = 'r' and cc.relkind = 'r'""",

    "partitioned_tables": f"""
select u.instance_id, u.fqn as object_name, 'CONSIDER' as severity,
       {label_case('p.partstrat', PARTITION_STRATEGY_LABELS)} as strategy,
       (select count(*) from cat_inherits i where i.instance_id = u.instance_id and i.inhparent = u.oid)
         as partition_count
from uc u join cat_partitioned p on p.instance_id = u.instance_id and p.partrelid = u.oid
where u.relkind = 'p'""",

    "row_level_security": """
select u.instance_id, u.fqn as object_name, 'WARNING' as severity, u.relforcerowsecurity as rls_forced,
       (select count(*) from cat_policy p where p.instance_id = u.instance_id and p.polrelid = u.oid)
         as policy_count
from uc u where u.relkind = 'r' and u.relrowsecurity""",

    "event_triggers": """
select instance_id, evtname as object_name,
       case evtenabled when 'A' then 'CONSIDER' when 'R' then 'WARNING' else 'INFO' end as severity,
       evtevent as event, evtenabled as enabled
from cat_event_trigger where evtenabled <> 'D'""",

    "notify_listen": r"""
select p.instance_id, n.nspname || '.' || p.proname as object_name, 'WARNING' as severity,
       'function' as source, cast(null as varchar) as query, cast(0 as bigint) as calls
from cat_proc p join ns n on n.instance_id = p.instance_id and n.relnamespace = p.pronamespace
where regexp_matches(p.prosrc, '(?i)pg_notify|\bnotify\b')
union all
select instance_id, '(query)', 'CONSIDER', 'statement', query, calls
from cur_stmt where regexp_matches(query, '(?is)pg_notify|\bnotify\b')""",

    "tablespace_usage": f"""
with t as (
  select u.instance_id, s.spcname,
         u.fqn || ' (' || {label_case('u.relkind', RELKIND_LABELS)} || ')' as label,
         row_number() over (partition by u.instance_id, s.spcname order by u.nspname, u.relname) as rn
  from uc u join cat_tablespace s on s.instance_id = u.instance_id and s.oid = u.reltablespace
  where u.relkind in ('r', 'i', 'm') and u.reltablespace <> 0)
select instance_id, spcname as object_name, 'CONSIDER' as severity, count(*) as object_count,
       string_agg(label, ',' order by rn) as objects
from t group by instance_id, spcname""",

    "temp_tables": r"""
select p.instance_id, n.nspname || '.' || p.proname as object_name, 'CONSIDER' as severity
from cat_proc p join ns n on n.instance_id = p.instance_id and n.relnamespace = p.pronamespace
where p.prokind in ('f', 'p') and regexp_matches(p.prosrc, '(?i)CREATE\s+(TEMP|TEMPORARY)\s+TABLE')""",
}
