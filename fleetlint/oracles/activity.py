"""Oracle SQL (DuckDB) for the activity (monitor) jobs."""

from __future__ import annotations

# Patterns of the oracle's own.
LOG_HEADER_RE = r"(?i)^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}(?:\.[0-9]+)?(?: [a-z]+)?)\s.*?(?:LOG|STATEMENT|ERROR):\s+(.*)"
LOG_STATEMENT_RE = r"(?i)\b(?:statement|execute\s+[^:\s]+):\s+(.*)"
LOG_DDL_RE = r"(?i)\b(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW|FUNCTION|PROCEDURE|TRIGGER|TYPE|SCHEMA|SEQUENCE)\b"
LOG_CONCURRENT_RE = r"(?i)\bCREATE\s+INDEX\s+CONCURRENTLY\b"

STMT_KEY = """
with s as (select *, coalesce(cast(queryid as varchar), sha256(coalesce(query, ''))) as stmt_key from stat_statements)
select instance_id, snapshot_no, stmt_key, min(query) as query, cast(sum(calls) as bigint) as calls,
       cast(sum(total_exec_time) as double) as total_exec_time, cast(sum(row_count) as bigint) as row_count
from s group by instance_id, snapshot_no, stmt_key"""

_DELTA_CTES = f"""k as ({STMT_KEY}),
sn as (select instance_id, snapshot_no, row_number() over (partition by instance_id order by snapshot_no desc) as pos
       from (select distinct instance_id, snapshot_no from k) x),
a as (select k.* from k join sn on sn.instance_id = k.instance_id and sn.snapshot_no = k.snapshot_no and sn.pos = 1),
b as (select k.* from k join sn on sn.instance_id = k.instance_id and sn.snapshot_no = k.snapshot_no and sn.pos = 2),
d as (select a.instance_id, a.stmt_key, a.query, case when b.calls is null then 'new' else 'changed' end as status,
             coalesce(a.calls - b.calls, a.calls) as delta_calls,
             coalesce(a.total_exec_time - b.total_exec_time, a.total_exec_time) as delta_time,
             coalesce(a.row_count - b.row_count, a.row_count) as delta_rows
      from a left join b on b.instance_id = a.instance_id and b.stmt_key = a.stmt_key
      where b.calls is null or a.calls - b.calls > 0)"""

STMT_DELTA = f"with {_DELTA_CTES}\nselect * from d"

STMT_DELTA_FINDINGS = f"""
with {_DELTA_CTES},
cnt as (select instance_id, count(*) filter (where status = 'new') as new_count,
               count(*) filter (where status = 'changed') as active_count from d group by instance_id),
nw as (select instance_id, string_agg(case when rn <= 20 then substr(query, 1, 150) end, chr(10) order by rn) as ex
       from (select *, row_number() over (partition by instance_id order by delta_calls desc, stmt_key) as rn
             from d where status = 'new') x group by instance_id),
top as (select * from d where status = 'changed'),
obs as (select instance_id, query, delta_calls, 'truncate_cascade' as kind from top
        where regexp_matches(query, '(?is)TRUNCATE.*CASCADE')
        union all
        select instance_id, query, delta_calls, 'concurrent_index' from top
        where regexp_matches(query, '(?is)CREATE\\s+INDEX\\s+CONCURRENTLY'))
select o.instance_id, '(observed)' as object_name, 'WARNING' as severity, o.kind, o.query,
       o.delta_calls, cast(null as varchar) as examples, c.new_count, c.active_count
from obs o join cnt c on c.instance_id = o.instance_id
union all
select n.instance_id, '(queries)', 'INFO', 'new', null, 0, n.ex, c.new_count, c.active_count
from nw n join cnt c on c.instance_id = n.instance_id
union all
select instance_id, '(monitor)', 'INFO', 'summary', null, 0, null, new_count, active_count from cnt"""

_WS = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
_ENTRIES = f"""l as (select *, regexp_matches(line, '{LOG_HEADER_RE}') as is_start from log_lines),
r as (select *, cast(sum(case when is_start then 1 else 0 end) over (partition by instance_id, file_id order by line_no
              rows between unbounded preceding and current row) as bigint) as entry_no from l),
h as (select instance_id, file_id, entry_no, line_no, regexp_extract(line, '{LOG_HEADER_RE}', 1) as ts,
             regexp_extract(line, '{LOG_HEADER_RE}', 2) as content from r where is_start),
h2 as (select *, regexp_matches(content, '{LOG_STATEMENT_RE}') as is_statement,
              case when regexp_matches(content, '{LOG_STATEMENT_RE}')
                   then regexp_extract(content, '{LOG_STATEMENT_RE}', 1) else content end as stmt from h),
c as (select instance_id, file_id, entry_no, string_agg({_WS}, ' ' order by line_no) as cont from r
      where not is_start and entry_no > 0 and starts_with(line, chr(9)) group by instance_id, file_id, entry_no),
e as (select h2.instance_id, h2.file_id, h2.entry_no, h2.line_no, h2.ts, h2.is_statement,
             case when c.cont is null then h2.stmt else h2.stmt || ' ' || c.cont end as text
      from h2 left join c on c.instance_id = h2.instance_id and c.file_id = h2.file_id and c.entry_no = h2.entry_no
      where h2.stmt <> '')"""

LOG_ASSEMBLE = f"with {_ENTRIES}\nselect * from e"

_CLASSES = f"""cl as (
  select e.*, 'concurrent_index' as class from e
    where regexp_matches(text, '{LOG_DDL_RE}') and regexp_matches(text, '{LOG_CONCURRENT_RE}')
  union all select e.*, 'ddl' from e
    where regexp_matches(text, '{LOG_DDL_RE}') and not regexp_matches(text, '{LOG_CONCURRENT_RE}')
  union all select e.*, 'truncate_cascade' from e where regexp_matches(text, '(?i)\\bTRUNCATE\\b.*\\bCASCADE\\b')
  union all select e.*, 'temp_table' from e where regexp_matches(text, '(?i)\\bCREATE\\s+(TEMP|TEMPORARY)\\s+TABLE\\b')
  union all select e.*, 'advisory_lock' from e where regexp_matches(text, '(?i)\\bpg_(try_)?advisory_lock'))"""

LOG_CLASSIFY = f"with {_ENTRIES},\n{_CLASSES}\nselect instance_id, file_id, entry_no, line_no, class from cl"

_SEV = "case kind when 'truncate_cascade' then 'WARNING' when 'concurrent_index' then 'WARNING' else 'INFO' end"
_LIM = "case kind when 'ddl' then 20 when 'truncate_cascade' then 10 when 'concurrent_index' then 10 else 0 end"
LOG_FINDINGS = f"""with {_ENTRIES},
{_CLASSES},
x as (select instance_id, class as kind, line_no, file_id, text,
             row_number() over (partition by instance_id, class order by file_id, line_no) as rn from cl)
select instance_id, '(log)' as object_name, {_SEV} as severity, kind, count(*) as occurrences,
       case when {_LIM} > 0 then string_agg(case when rn <= {_LIM} then 'line ' || cast(line_no as varchar) || ': '
            || substr(text, 1, 150) end, chr(10) order by rn) end as examples
from x group by instance_id, kind
union all
select instance_id, '(log)', 'INFO', 'summary', count(*) filter (where is_statement), null from e
group by instance_id"""

_NAMES = ("case kind when 'truncate_cascade' then 'TRUNCATE with CASCADE' when 'concurrent_index' then 'an index build without a lock' "
          "when 'ddl' then 'schema changes' when 'advisory_lock' then 'advisory locks' when 'temp_table' then 'temporary tables' end")
_ADVICE = ("case kind when 'truncate_cascade' then 'Name the dependent tables in the TRUNCATE: a cascade takes effect on the node it runs on only.' "
           "when 'concurrent_index' then 'Build the index on every node by hand.' "
           "when 'ddl' then 'Send schema changes through DDL replication, or run them on all nodes in step.' end")
_MONITOR = f"""mf as (
  select instance_id, 'pgstat_observation' as check_name, 'monitor' as category, severity, object_name,
         case kind when 'summary' then (active_count + new_count) || ' statement(s) ran between the snapshots, ' || new_count || ' of them new'
              when 'new' then new_count || ' new statement(s)' else 'Seen ' || delta_calls || ' time(s): ' || {_NAMES} end as title,
         coalesce(query, examples, 'Active: ' || active_count || ', new: ' || new_count) as detail, {_ADVICE} as remediation
  from ({STMT_DELTA_FINDINGS}) x
  union all
  select instance_id, 'log_analysis', 'monitor', severity, object_name,
         case kind when 'summary' then occurrences || ' statement(s) in the log' else 'The log holds ' || {_NAMES} || ' (' || occurrences || ')' end,
         coalesce(examples, case kind when 'advisory_lock' then 'A lock taken on one node is not known to the others.'
                  when 'temp_table' then 'Temporary tables live in one session and are not replicated.' else 'All entries of the log' end), {_ADVICE}
  from ({LOG_FINDINGS}) y),
mr as (select instance_id, check_name, category, severity, case severity when 'WARNING' then 1::BIGINT else 3::BIGINT end as severity_rank,
              object_name, title, detail, remediation from mf)"""

SQL = {
    "monitor_findings": f"with {_MONITOR}\nselect * from mr",
    "monitor_todo": f"""with {_MONITOR}
select instance_id, severity, severity_rank, check_name, category, object_name, remediation from mr
where severity in ('WARNING', 'INFO') and remediation is not null""",
    "stmt_key": STMT_KEY,
    "stmt_delta": STMT_DELTA,
    "stmt_delta_findings": STMT_DELTA_FINDINGS,
    "log_assemble": LOG_ASSEMBLE,
    "log_classify": LOG_CLASSIFY,
    "log_findings": LOG_FINDINGS,
}
