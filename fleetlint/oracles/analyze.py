"""Oracle SQL (DuckDB) of the offline audit: the checks read straight from the dump facts.

Foreign keys, inheritance, large objects and indexes of foreign keys are compared too: the facts of
the fixture hold none of them, so any such finding would be a mismatch."""

from __future__ import annotations

from .dump import SQL as FACTS

OFFLINE = {"schema": ["column_defaults", "deferrable_constraints", "enum_types", "exclusion_constraints", "foreign_keys", "generated_columns", "inheritance", "large_objects",
                      "missing_fk_indexes", "multiple_unique_indexes", "numeric_columns", "primary_keys", "rules", "sequence_pks", "unlogged_tables"],
           "config": ["pg_version"], "extensions": ["installed_extensions"], "sequences": ["sequence_audit", "sequence_data_types"]}
_COUNTERS = ["count", "total", "sum", "balance", "quantity", "qty", "amount", "tally", "counter", "num_", "cnt", "running_", "cumulative", "aggregate", "accrued", "inventory"]
_NUMBERS = ["integer", "bigint", "smallint", "numeric", "real", "double precision"]
_VOLATILE = ["now()", "current_timestamp", "current_date", "current_time", "clock_timestamp()", "random()", "gen_random_uuid()", "uuid_generate_v4()"]


def _any(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_FACT_CTES = ",\n".join(f"{n.removeprefix('dump_')[:4]}_f as ({FACTS[n]})" for n in (
    "dump_tables", "dump_columns", "dump_constraints", "dump_indexes", "dump_sequences", "dump_enums", "dump_rules", "dump_extensions"))
_SAME = "{a}.instance_id = {b}.instance_id and {a}.file_id = {b}.file_id and {a}.schema_name = {b}.schema_name and {a}.table_name = {b}.table_name"
_KEY = _SAME.format(a="k", b="t")
_T = "t.schema_name || '.' || t.table_name"


def _rows(check: str, severity: str, obj: str, source: str) -> str:
    category = next(c for c, names in OFFLINE.items() if check in names)
    return f"select t.instance_id, t.file_id, '{check}' as check_name, '{category}' as category, {severity} as severity, {obj} as object_name from {source}"


_FINDINGS = "\nunion all\n".join([
    _rows("primary_keys", "'WARNING'", _T, f"tabl_f t where t.partition_by is null and not exists (select 1 from cons_f k where k.contype = 'p' and {_KEY})"),
    _rows("unlogged_tables", "'WARNING'", _T, "tabl_f t where t.unlogged and t.partition_by is null"),
    _rows("enum_types", "'CONSIDER'", "t.schema_name || '.' || t.type_name", "enum_f t"),
    _rows("rules", "case when t.is_instead then 'WARNING' else 'CONSIDER' end", f"{_T} || '.' || t.rule_name", "rule_f t"),
    _rows("sequence_audit", "'WARNING'", "t.schema_name || '.' || t.sequence_name", "sequ_f t"),
    _rows("sequence_data_types", "'WARNING'", "t.schema_name || '.' || t.sequence_name", "sequ_f t where t.data_type in ('smallint', 'integer')"),
    _rows("sequence_pks", "'CRITICAL'", _T, f"colu_f t join cons_f k on k.contype = 'p' and {_KEY} and list_contains(string_split(k.columns, ','), t.column_name) "
          "where coalesce(contains(lower(t.default_expr), 'nextval('), false) or t.identity <> ''"),
    _rows("numeric_columns", "case when t.not_null then 'CONSIDER' else 'WARNING' end", f"{_T} || '.' || t.column_name",
          f"colu_f t where trim(regexp_replace(lower(t.data_type), '\\(.*$', '')) in ({', '.join(repr(x) for x in _NUMBERS)}) and {_any('t.column_name', _COUNTERS)}"),
    _rows("column_defaults", "'CONSIDER'", f"{_T} || '.' || t.column_name", f"colu_f t where t.generated = '' and not contains(lower(t.default_expr), 'nextval(') and {_any('t.default_expr', _VOLATILE)}"),
    _rows("generated_columns", "'CONSIDER'", f"{_T} || '.' || t.column_name", "colu_f t where t.generated <> ''"),
    _rows("deferrable_constraints", "case when t.contype = 'p' then 'CRITICAL' else 'WARNING' end", f"{_T} || '.' || t.constraint_name", "cons_f t where t.deferrable and t.contype in ('p', 'u')"),
    _rows("exclusion_constraints", "'WARNING'", f"{_T} || '.' || t.constraint_name", "cons_f t where t.contype = 'x'"),
    _rows("foreign_keys", "'CONSIDER'", "'(database)'", "(select distinct instance_id, file_id from cons_f where contype = 'f') t"),
    _rows("multiple_unique_indexes", "'CONSIDER'", _T, "(select instance_id, file_id, schema_name, table_name from (select instance_id, file_id, schema_name, table_name from inde_f where is_unique "
          "union all select instance_id, file_id, schema_name, table_name from cons_f where contype in ('p', 'u')) u group by all having count(*) > 1) t"),
    _rows("installed_extensions", "'CONSIDER'", "'(extensions)'", "(select distinct instance_id, file_id from exte_f) t"),
    _rows("pg_version", "'WARNING'", "'pg_version'", "(select distinct instance_id, file_id from dump_lines d where not exists (select 1 from dump_lines v where v.instance_id = d.instance_id "
          "and v.file_id = d.file_id and regexp_matches(v.line, '^--\\s*Dumped\\s+from\\s+database\\s+version\\s'))) t"),
])
_RANK = "case severity when 'CRITICAL' then 0 when 'WARNING' then 1 when 'CONSIDER' then 2 else 3 end"
_AF = f"{_FACT_CTES},\naf as (\n{_FINDINGS}\n)"

FINDINGS = f"with {_AF}\nselect instance_id, file_id, check_name, category, severity, cast({_RANK} as bigint) as severity_rank, object_name from af"


def status(checks: list[tuple[str, str]]) -> str:
    """Status of every (check, category) for every dump."""
    offline = ", ".join(f"'{n}'" for names in OFFLINE.values() for n in names)
    values = ", ".join(f"('{n}', '{c}')" for n, c in checks)
    return f"""with {_AF},
ck(check_name, category) as (values {values}),
dumps as (select distinct instance_id, file_id from dump_lines),
n as (select instance_id, file_id, check_name, count(*) as n from af group by all)
select d.instance_id, d.file_id, ck.check_name, ck.category,
       case when ck.check_name not in ({offline}) then 'skipped' when n.n > 0 then 'failed' else 'passed' end as status,
       coalesce(n.n, 0) as finding_count, case when ck.check_name not in ({offline}) then 'live only' end as skip_reason, cast(null as varchar) as error
from dumps d cross join ck left join n on n.instance_id = d.instance_id and n.file_id = d.file_id and n.check_name = ck.check_name"""
