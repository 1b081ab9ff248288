"""Oracle SQL (DuckDB) for the sequence checks."""

from __future__ import annotations

_SEQ = ("from cat_sequence s join ns n on n.instance_id = s.instance_id and n.relnamespace = s.relnamespace")

SQL = {
    "sequence_audit": f"""
select s.instance_id, n.nspname || '.' || s.relname as object_name, 'WARNING' as severity, s.data_type,
       cast(s.seqstart as bigint) as start_value, cast(s.seqincrement as bigint) as increment,
       cast(s.seqmax as bigint) as max_value, s.seqcycle as is_cycle, s.refobjid is not null as is_owned,
       c.relname as owner_table, a.attname as owner_column
{_SEQ}
left join cat_class c on c.instance_id = s.instance_id and c.oid = s.refobjid
left join cat_attribute a on a.instance_id = s.instance_id and a.attrelid = s.refobjid and a.attnum = s.refobjsubid""",

    "sequence_data_types": f"""
select s.instance_id, n.nspname || '.' || s.relname as object_name, 'WARNING' as severity, s.data_type,
       cast(s.seqmax as bigint) as max_value,
       cast(case when s.data_type = 'smallint' then 32767 else 2147483647 end as bigint) as type_max
{_SEQ} where s.data_type in ('smallint', 'integer')""",
}
