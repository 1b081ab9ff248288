"""Derived catalog views over the driver tables (FIXTURES.md section 2).

Each view is one SQL statement over the base tables.  The same text runs on
Spark (base tables bound as DataFrame parameters) and on DuckDB (oracle side).
Dialect token: ``ARR(`` is ``array(`` in Spark and ``list_value(`` in DuckDB.
"""

from __future__ import annotations

# The view definitions of FIXTURES.md section 2, in document order.
VIEW_SQL: dict[str, str] = {
    'instances': (
        "select r_regionkey as instance_id, 'cluster_' || cast(r_regionkey % 2 as varchar(20)) as cluster_id "
        'from region'
    ),
    'cat_namespace': (
        "select r_regionkey as instance_id, n_nationkey as oid, case n_nationkey when 0 then 'pg_catalog' "
        "when 1 then 'information_schema' when 2 then 'spock' when 3 then 'pg_toast' else n_name end as "
        'nspname from nation cross join region'
    ),
    'cat_class': (
        "select p_partkey % 5 as instance_id, p_partkey as oid, p_size % 25 as relnamespace, 't_' || "
        "cast(p_partkey as varchar(20)) as relname, case when b < 6 then 'r' when b = 6 then 'p' when b = 7 "
        "then 'i' when b = 8 then 'm' else 'v' end as relkind, case when p_type = 'PROMO' then 'u' else 'p' "
        "end as relpersistence, p_type = 'SMALL' as relrowsecurity, p_type = 'SMALL' and p_size % 2 = 0 as "
        "relforcerowsecurity, case when p_type = 'LARGE' then p_size % 3 + 1 else 0 end as reltablespace from "
        '(select *, cast(substr(p_brand, 7) as int) % 10 as b from part) x'
    ),
    'cat_attribute': (
        'select l_partkey % 5 as instance_id, l_partkey as attrelid, l_linenumber as attnum, case '
        "l_linenumber when 1 then 'id' when 2 then 'total_count' when 3 then 'balance' when 4 then "
        "'created_at' when 5 then 'note' when 6 then 'qty_on_hand' else 'file_ref' end as attname, case "
        "l_linenumber when 1 then 'bigint' when 2 then 'integer' when 3 then 'numeric' when 4 then "
        "'timestamp' when 5 then 'text' when 6 then 'bigint' else 'oid' end as atttype, min(l_suppkey) % 2 = "
        "0 as attnotnull, case when l_linenumber = 3 and min(l_orderkey) % 3 = 0 then 's' else '' end as "
        "attgenerated, case when l_linenumber = 1 and min(l_orderkey) % 2 = 0 then 'a' else '' end as "
        "attidentity, case when l_linenumber = 4 and min(l_orderkey) % 3 = 0 then 'now()' when l_linenumber = "
        "1 and min(l_orderkey) % 2 = 1 then 'nextval(''s_seq''::regclass)' when l_linenumber = 3 and "
        "min(l_orderkey) % 3 = 0 then '(id + 1)' end as default_expr from lineitem group by l_partkey, "
        'l_linenumber'
    ),
    'cat_constraint': (
        "select relid % 5 as instance_id, o_orderkey as oid, relid as conrelid, 'con_' || cast(o_orderkey as "
        "varchar(20)) as conname, case when o_orderkey % 31 < 2 then 'p' when o_orderkey % 31 < 4 then 'u' "
        "when o_orderkey % 31 = 4 then 'x' else 'f' end as contype, case when o_custkey % 2 = 0 then "
        'ARR(o_orderkey % 7 + 1) else ARR(o_orderkey % 7 + 1, o_custkey % 7 + 1) end as conkey, (relid + 5 * '
        "o_custkey) % np as confrelid, o_orderstatus = 'P' as condeferrable, o_orderstatus = 'P' and "
        "o_orderpriority = '1-URGENT' as condeferred, case substr(o_orderpriority, 1, 1) when '1' then 'c' "
        "when '2' then 'a' when '3' then 'r' when '4' then 'n' else 'd' end as confdeltype, 'a' as "
        'confupdtype from (select o.*, c.np, (o.o_orderkey * 7) % c.np as relid from orders o cross join '
        '(select count(*) as np from part) c) x'
    ),
    'cat_index': (
        "select distinct l_partkey % 5 as instance_id, l_partkey as indrelid, 'ix_' || cast(l_partkey as "
        "varchar(20)) || '_' || cast(l_linenumber as varchar(20)) || '_' || cast(l_suppkey % 21 as "
        'varchar(20)) as indexname, ARR(cast(l_linenumber as bigint), l_suppkey % 7 + 1) as indkey, l_suppkey '
        '% 3 = 0 as indisunique from lineitem'
    ),
    'cat_table_stats': (
        "select user_id % 5 as instance_id, user_id as relid, sum(case when event_type = 'signup' then 1 else "
        "0 end) as n_tup_ins, sum(case when event_type = 'purchase' and user_id % 3 = 0 then 1 else 0 end) as "
        "n_tup_upd, sum(case when event_type = 'error' and user_id % 3 = 0 then 1 else 0 end) as n_tup_del "
        'from events group by user_id'
    ),
    'cat_inherits': (
        'select p_partkey % 5 as instance_id, p_partkey as inhrelid, (p_partkey + 5 * p_size) % np as '
        'inhparent from part cross join (select count(*) as np from part) c where p_size % 2 = 0'
    ),
    'cat_partitioned': (
        "select p_partkey % 5 as instance_id, p_partkey as partrelid, case p_size % 3 when 0 then 'r' when 1 "
        "then 'l' else 'h' end as partstrat from part where cast(substr(p_brand, 7) as int) % 10 = 6"
    ),
    'cat_policy': (
        'select o_orderkey % 5 as instance_id, o_orderkey as oid, (o_orderkey + 5 * o_custkey) % np as '
        'polrelid from orders cross join (select count(*) as np from part) c'
    ),
    'cat_rewrite': (
        "select c_custkey % 5 as instance_id, c_custkey as ev_class, 'rule_' || cast(c_custkey as "
        "varchar(20)) as rulename, case c_nationkey % 4 when 0 then '1' when 1 then '2' when 2 then '3' else "
        "'4' end as ev_type, c_nationkey % 3 = 0 as is_instead from customer"
    ),
    'cat_enum': (
        "select p_partkey % 5 as instance_id, p_size % 25 as typnamespace, p_type as typname, 'v' || "
        'cast(p_partkey as varchar(20)) as enumlabel, p_partkey as enumsortorder from part'
    ),
    'cat_sequence': (
        "select s_suppkey % 5 as instance_id, s_nationkey as relnamespace, 'seq_' || cast(s_suppkey as "
        "varchar(20)) as relname, case s_nationkey % 3 when 0 then 'smallint' when 1 then 'integer' else "
        "'bigint' end as data_type, s_suppkey + 1 as seqstart, 1 as seqincrement, case s_nationkey % 3 when 0 "
        'then 32767 when 1 then 2147483647 else 9223372036854775807 end as seqmax, s_nationkey % 7 = 0 as '
        'seqcycle, case when s_nationkey % 2 = 0 then s_suppkey end as refobjid, case when s_nationkey % 2 = '
        '0 then 1 end as refobjsubid from supplier'
    ),
    'cat_proc': (
        "select doc_id % 5 as instance_id, doc_id as oid, doc_id % 25 as pronamespace, 'fn_' || cast(doc_id "
        "as varchar(20)) as proname, case when doc_id % 9 = 0 then 'p' else 'f' end as prokind, case doc_id % "
        "4 when 0 then 'plpgsql' when 1 then 'sql' when 2 then 'plperl' else 'c' end as lanname, case doc_id "
        "% 3 when 0 then 'i' when 1 then 's' else 'v' end as provolatile, case doc_id % 7 when 0 then 'begin "
        "perform pg_notify(''ch'', x); end' when 1 then 'begin insert into t values (1); delete from t; end' "
        "when 2 then 'begin create temp table s (x int); end' when 3 then 'begin NOTIFY ch; end' when 4 then "
        "'begin update t set a = 1; end' else 'select 1' end as prosrc from documents"
    ),
    'cat_trigger': (
        "select c_custkey % 5 as instance_id, c_custkey as tgrelid, 'trg_' || cast(c_custkey as varchar(20)) "
        'as tgname, case c_nationkey % 6 when 0 then 5 when 1 then 7 when 2 then 9 when 3 then 17 when 4 then '
        "69 else 28 end as tgtype, case c_nationkey % 4 when 0 then 'O' when 1 then 'A' when 2 then 'R' else "
        "'D' end as tgenabled, c_custkey % 11 = 0 as tgisinternal, c_custkey % 97 as tgfoid from customer"
    ),
    'cat_event_trigger': (
        "select s_suppkey % 5 as instance_id, 'evt_' || cast(s_suppkey as varchar(20)) as evtname, case "
        "s_nationkey % 2 when 0 then 'ddl_command_start' else 'sql_drop' end as evtevent, case s_nationkey % "
        "4 when 0 then 'O' when 1 then 'A' when 2 then 'R' else 'D' end as evtenabled from supplier"
    ),
    'cat_tablespace': (
        "select r_regionkey as instance_id, v.oid, 'ts_' || cast(v.oid as varchar(20)) as spcname from region "
        'cross join (values (1), (2), (3)) as v(oid)'
    ),
    'cat_largeobject': (
        'select c_custkey % 5 as instance_id, c_custkey as oid from customer where c_custkey % 5 < 3'
    ),
    'cat_database': (
        "select n_nationkey % 5 as instance_id, case when n_nationkey < 5 then 'postgres' else 'db_' || "
        'cast(n_nationkey as varchar(20)) end as datname, n_nationkey % 7 = 0 as datistemplate, case '
        "n_nationkey % 5 when 4 then 'LATIN1' else 'UTF8' end as encoding from nation where n_nationkey % 5 "
        '<> 2 or n_nationkey < 10'
    ),
    'settings': (
        "select i.instance_id, v.name, case v.name when 'wal_level' then case when i.instance_id % 2 = 0 then "
        "'logical' else 'replica' end when 'track_commit_timestamp' then case when i.instance_id < 3 then "
        "'on' else 'off' end when 'max_replication_slots' then cast(4 + 3 * i.instance_id as varchar(20)) "
        "when 'max_wal_senders' then cast(5 + 2 * i.instance_id as varchar(20)) when 'max_worker_processes' "
        "then cast(8 * (i.instance_id + 1) as varchar(20)) when 'max_logical_replication_workers' then "
        "cast(i.instance_id + 2 as varchar(20)) when 'max_sync_workers_per_subscription' then "
        "cast(i.instance_id as varchar(20)) when 'server_version_num' then cast(140005 + 10000 * "
        "i.instance_id as varchar(20)) when 'shared_preload_libraries' then case when i.instance_id % 2 = 0 "
        "then 'pg_stat_statements, spock' else 'auto_explain' end when 'timezone' then case when "
        "i.instance_id < 4 then 'UTC' else 'Europe/Rome' end when 'log_timezone' then case when i.instance_id "
        "< 2 then 'UTC' else 'GMT' end when 'idle_in_transaction_session_timeout' then case when "
        "i.instance_id = 1 then '60000' else '0' end when 'idle_session_timeout' then '0' when "
        "'spock.conflict_resolution' then case when i.instance_id < 2 then 'last_update_wins' else 'error' "
        "end when 'lolor.node' then cast(i.instance_id as varchar(20)) end as setting from (select "
        "r_regionkey as instance_id from region) i cross join (values ('wal_level'), "
        "('track_commit_timestamp'), ('max_replication_slots'), ('max_wal_senders'), "
        "('max_worker_processes'), ('max_logical_replication_workers'), "
        "('max_sync_workers_per_subscription'), ('server_version_num'), ('shared_preload_libraries'), "
        "('timezone'), ('log_timezone'), ('idle_in_transaction_session_timeout'), ('idle_session_timeout'), "
        "('spock.conflict_resolution'), ('lolor.node')) as v(name)"
    ),
    'cat_extension': (
        "select i.instance_id, v.extname, '1.' || cast(v.n as varchar(20)) as extversion, '1.' || cast(case "
        'when v.n % 2 = 0 then v.n else v.n + 1 end as varchar(20)) as default_version, (v.n + i.instance_id) '
        '% 3 <> 0 as installed from (select r_regionkey as instance_id from region) i cross join (values '
        "('postgis', 1), ('citus', 2), ('hstore', 3), ('lolor', 4), ('snowflake', 5), ('pg_stat_statements', "
        "6), ('lo', 7), ('custom_ext', 8)) as v(extname, n)"
    ),
    'hba_rules': (
        'select s_suppkey % 5 as instance_id, s_suppkey as line_number, case when s_nationkey % 5 = 0 and '
        "s_suppkey % 5 < 4 then ARR('all', 'replication') else ARR('all') end as databases from supplier"
    ),
    'replication_slots': (
        "select s_suppkey % 5 as instance_id, 'slot_' || cast(s_suppkey as varchar(20)) as slot_name, "
        "'logical' as slot_type, s_nationkey % 3 = 0 as active, case s_nationkey % 4 when 0 then '0/0' when 1 "
        "then '0/F0000000' when 2 then '1/10000000' end as restart_lsn, '1/20000000' as current_lsn from "
        'supplier'
    ),
    'subscriptions': (
        "select s_suppkey % 5 as instance_id, 'sub_' || cast(s_suppkey as varchar(20)) as sub_name, "
        "s_nationkey % 4 <> 0 as sub_enabled, 'slot_' || cast(s_suppkey + case when s_nationkey % 6 = 0 then "
        '1000 else 0 end as varchar(20)) as sub_slot_name from supplier'
    ),
    'repset_table': (
        'select p_partkey % 5 as instance_id, p_partkey as set_reloid from part where p_size % 3 <> 0'
    ),
    'conflict_history': (
        "select o_custkey % 5 as instance_id, 't_' || cast(o_custkey % 40 as varchar(20)) as table_name, "
        'o_orderstatus as conflict_type, o_orderpriority as resolution, o_orderdate as conflict_ts from '
        'orders'
    ),
    'exception_log': (
        "select user_id % 5 as instance_id, user_id % 5 as remote_origin, 't_' || cast(user_id % 20 as "
        'varchar(20)) as table_name, props as error_message, ts as exception_time from events where '
        "event_type = 'error'"
    ),
    'stat_statements': (
        'select s.snapshot_no, e.user_id % 5 as instance_id, case when e.user_id % 10 = 0 then null else '
        "e.user_id end as queryid, case e.user_id % 12 when 0 then 'TRUNCATE TABLE t CASCADE' when 1 then "
        "'CREATE INDEX CONCURRENTLY i ON t (c)' when 2 then 'ALTER TABLE t ADD c int' when 3 then 'SELECT "
        "pg_advisory_lock(1)' when 4 then 'CREATE TEMP TABLE x (a int)' when 5 then 'TRUNCATE t RESTART "
        "IDENTITY' when 6 then 'NOTIFY ch' when 7 then 'CREATE INDEX i ON t (c)' else 'SELECT 1' end || ' /* "
        "' || cast(e.user_id as varchar(20)) || ' */' as query, count(*) as calls, count(*) * 5 as row_count, "
        'max(e.event_id) as total_exec_time from events e cross join (values (1), (2)) as s(snapshot_no) '
        "where s.snapshot_no = 2 or (e.ts < timestamp '2024-01-16 00:00:00' and e.user_id % 9 <> 0) group by "
        's.snapshot_no, e.user_id'
    ),
    'log_lines': (
        "select conv_id % 5 as instance_id, conv_id as file_id, turn as line_no, case when role = 'user' then "
        "'2026-01-27 13:15:04.123 UTC [' || cast(conv_id as varchar(20)) || '] LOG:  statement: ' || case "
        "(conv_id * 7 + turn) % 6 when 0 then 'CREATE INDEX CONCURRENTLY i ON t (c)' when 1 then 'TRUNCATE "
        "TABLE t' when 2 then 'ALTER TABLE t ADD c int' when 3 then 'SELECT pg_advisory_lock(1)' when 4 then "
        "'CREATE TEMP TABLE x (a int)' else 'SELECT 1' end when turn % 5 = 4 then 'noise without a header' "
        "else chr(9) || case turn % 3 when 0 then 'CASCADE' else 'WHERE a = 1' end end as line from "
        'conversations'
    ),
    'dump_lines': (
        'select p_partkey % 5 as instance_id, p_partkey % 5 as file_id, p_partkey * 16 + v.k as line_no, case '
        "v.k when 1 then '-- Name: t_' || cast(p_partkey as varchar(20)) when 2 then 'CREATE ' || case when "
        "p_type = 'PROMO' then 'UNLOGGED ' else '' end || 'TABLE public.t_' || cast(p_partkey as varchar(20)) "
        "|| ' (' when 3 then '    id bigint NOT NULL,' when 4 then '    total_count numeric(10,2) DEFAULT 0' "
        "when 5 then ');' when 6 then case when p_size % 2 = 0 then 'ALTER TABLE ONLY public.t_' || cast(p_partkey "
        "as varchar(20)) || ' ADD CONSTRAINT pk_' || cast(p_partkey as varchar(20)) || ' PRIMARY KEY (id);' "
        "else 'CREATE INDEX ix_' || cast(p_partkey as varchar(20)) || ' ON public.t_' || cast(p_partkey as "
        "varchar(20)) || ' USING btree (id);' end "
        "when 7 then 'CREATE SEQUENCE public.s_' || cast(p_partkey as varchar(20)) || ' AS integer START WITH ' || "
        "cast(p_size as varchar(20)) || case when p_size % 3 = 0 then ' INCREMENT BY -1 MINVALUE -100 CYCLE;' "
        "else ' INCREMENT BY 1 NO MINVALUE NO CYCLE;' end "
        "when 8 then 'ALTER SEQUENCE public.s_' || cast(p_partkey as varchar(20)) || ' OWNED BY public.t_' || "
        "cast(p_partkey as varchar(20)) || '.id;' "
        "when 9 then case when p_size % 2 = 0 then 'ALTER TABLE ONLY public.t_' || cast(p_partkey as varchar(20)) || "
        "' ALTER COLUMN id SET DEFAULT nextval(7);' else 'ALTER TABLE public.t_' || cast(p_partkey as varchar(20)) || "
        "' ALTER COLUMN id ADD GENERATED BY DEFAULT AS IDENTITY;' end "
        "when 10 then 'CREATE TYPE public.e_' || cast(p_partkey as varchar(20)) || ' AS ENUM (' || chr(39) || 'a' || chr(39) || "
        "', ' || chr(39) || 'b c' || cast(p_size as varchar(20)) || chr(39) || ');' "
        "when 11 then 'CREATE RULE r_' || cast(p_partkey as varchar(20)) || ' AS ON INSERT TO public.t_' || "
        "cast(p_partkey as varchar(20)) || case when p_size % 2 = 0 then ' DO INSTEAD NOTHING;' else ' DO ALSO NOTHING;' end "
        "else case when p_partkey < 10 then 'CREATE EXTENSION IF NOT EXISTS x_' || cast(p_partkey as varchar(20)) || "
        "' WITH SCHEMA public;' else '-- no extension' end end "
        'as line from part cross join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) as v(k)'
    ),
}
