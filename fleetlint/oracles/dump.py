"""Oracle SQL (DuckDB) for the schema-dump statement split and simple facts."""

from __future__ import annotations

# Patterns of the oracle's own: names are runs without blanks, brackets or semicolons.
EXCLUDED_NAMESPACES = ("pg_catalog", "information_schema", "spock", "pg_toast")
_N = r"([^\s(;]+)"
_INE = r"(?:IF\s+NOT\s+EXISTS\s+)?"
RE_VERSION = r"Dumped\s+from\s+database\s+version\s+(\S+)"
RE_SEARCH_PATH = r"(?i)set_config\s*\(\s*'search_path'\s*,\s*'([^']*)'|^SET\s+search_path\s*(?:=|TO)\s*([^;]+);"
RE_DOLLAR = r"(\$[A-Za-z0-9_]*\$)"
RE_EXTENSION = rf"(?i)^\s*CREATE\s+EXTENSION\s+{_INE}{_N}(?:\s+WITH)?(?:\s+SCHEMA\s+([^\s;]+))?"
RE_ENUM = rf"(?i)^\s*CREATE\s+TYPE\s+{_N}\s+AS\s+ENUM"
RE_SEQUENCE = rf"(?i)^\s*CREATE\s+SEQUENCE\s+{_INE}{_N}"
RE_TABLE = rf"(?i)^\s*CREATE\s+(UNLOGGED\s+)?TABLE\s+{_INE}{_N}\s*\("
_ALTER = rf"(?i)^\s*ALTER\s+TABLE\s+(?:ONLY\s+)?{_N}\s+"
RE_ADD_CONSTRAINT = _ALTER + rf"ADD\s+CONSTRAINT\s+{_N}\s+(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|EXCLUDE|CHECK)"
RE_INDEX = rf"(?i)^\s*CREATE\s+(UNIQUE\s+)?INDEX\s+{_INE}{_N}\s+ON\s+(?:ONLY\s+)?{_N}"
RE_SET_DEFAULT = _ALTER + rf"ALTER\s+COLUMN\s+{_N}\s+SET\s+DEFAULT\s+([^;]+);"
RE_ADD_IDENTITY = _ALTER + rf"ALTER\s+COLUMN\s+{_N}\s+ADD\s+GENERATED\s+(ALWAYS|BY\s+DEFAULT)\s+AS\s+IDENTITY"
RE_SEQ_OWNED = r"(?i)^\s*ALTER\s+SEQUENCE\s+([^\s;]+)\s+OWNED\s+BY\s+([^\s;]+)\.([^\s;.]+)"
RE_RULE = rf"(?i)^\s*CREATE\s+RULE\s+{_N}\s+AS\s+ON\s+([A-Z]+)\s+TO\s+{_N}\s+DO\s+(INSTEAD\s)?"
STATEMENT_KINDS = [("extension", RE_EXTENSION), ("enum", RE_ENUM), ("sequence", RE_SEQUENCE), ("table", RE_TABLE),
                   ("constraint", RE_ADD_CONSTRAINT), ("index", RE_INDEX), ("default", RE_SET_DEFAULT),
                   ("identity", RE_ADD_IDENTITY), ("owned_by", RE_SEQ_OWNED), ("rule", RE_RULE)]
RE_INHERITS = r"(?i)\)\s*INHERITS\s*\(([^)]+)\)"
RE_PARTITION_BY = r"(?i)\)\s*PARTITION\s+BY\s+([^;]+)"
RE_USING = r"(?i)\sUSING\s+([a-z]+)"
RE_COLUMN = r"^([^\s]+)\s+(.+)$"
RE_TABLE_CONSTRAINT = r"(?i)^(?:PRIMARY\s|UNIQUE\s|FOREIGN\s|EXCLUDE\s|CHECK\s|CONSTRAINT\s)"
_OPTION = r"(?:NOT\s+NULL|NULL|DEFAULT|GENERATED|COLLATE|CONSTRAINT|PRIMARY|UNIQUE|REFERENCES|CHECK)"
RE_TYPE_END = rf"(?i)^(.*?)(?:\s+{_OPTION}\b.*)?$"
RE_NOT_NULL = r"(?i)\bNOT\s+NULL\b"
RE_DEFAULT = rf"(?i)\bDEFAULT\s+(.+?)(?:\s+{_OPTION}\b.*)?$"
RE_GENERATED = r"(?i)\bGENERATED\s+ALWAYS\s+AS\s*\((.+)\)\s*STORED"
RE_IDENTITY = r"(?i)\bGENERATED\s+(ALWAYS|BY\s+DEFAULT)\s+AS\s+IDENTITY"
RE_CONSTRAINT_NAME = r"(?i)^CONSTRAINT\s+([^\s]+)\s"
RE_REFERENCES = r"(?i)REFERENCES\s+([^\s(]+)\s*\(([^)]+)\)"
_ACTIONS = r"(CASCADE|SET\s+NULL|SET\s+DEFAULT|RESTRICT|NO\s+ACTION)"
RE_ON_DELETE, RE_ON_UPDATE = rf"(?i)ON\s+DELETE\s+{_ACTIONS}", rf"(?i)ON\s+UPDATE\s+{_ACTIONS}"
RE_DEFERRABLE, RE_NOT_DEFERRABLE = r"(?i)\bDEFERRABLE\b", r"(?i)\bNOT\s+DEFERRABLE\b"
RE_INITIALLY_DEFERRED = r"(?i)\bINITIALLY\s+DEFERRED\b"
CONTYPE_CODES = {"PRIMARY KEY": "p", "UNIQUE": "u", "FOREIGN KEY": "f", "EXCLUDE": "x", "CHECK": "c"}
FK_ACTION_CODES = {"CASCADE": "c", "SET NULL": "n", "SET DEFAULT": "d", "RESTRICT": "r", "NO ACTION": "a"}
SEQ_OPTIONS = {"data_type": r"(?i)\sAS\s+(smallint|integer|bigint)", "start_value": r"(?i)\sSTART\s+WITH\s+(-?[0-9]+)",
               "increment": r"(?i)\sINCREMENT\s+BY\s+(-?[0-9]+)", "min_value": r"(?i)\sMINVALUE\s+(-?[0-9]+)",
               "max_value": r"(?i)\sMAXVALUE\s+(-?[0-9]+)"}


def _q(s: str) -> str:
    return s.replace("'", "''")


_EXCL = ", ".join(f"'{n}'" for n in EXCLUDED_NAMESPACES)
_W = "partition by instance_id, file_id order by line_no"
_KIND = "case " + " ".join(
    (f"when regexp_matches(text, '{_q(rx)}') and starts_with(upper(trim(text, ' ' || chr(9) || chr(10))), 'CREATE') "
     f"then '{k}'") if k == "extension" else f"when regexp_matches(text, '{_q(rx)}') then '{k}'"
    for k, rx in STATEMENT_KINDS) + " else 'other' end"

STATEMENTS_CTES = f"""b as (select instance_id, file_id, line_no, line,
                  regexp_replace(line, '^\\s+|\\s+$', '', 'g') as stripped from dump_lines),
ver as (select instance_id, file_id, min_by(regexp_extract(stripped, '{_q(RE_VERSION)}', 1), line_no) as pg_version
        from b where starts_with(stripped, '--') and regexp_extract(stripped, '{_q(RE_VERSION)}', 1) <> ''
        group by instance_id, file_id),
l as (select *, case when regexp_matches(stripped, '{_q(RE_SEARCH_PATH)}') then list_filter(list_transform(
              string_split(coalesce(nullif(regexp_extract(stripped, '{_q(RE_SEARCH_PATH)}', 1), ''),
                                    nullif(regexp_extract(stripped, '{_q(RE_SEARCH_PATH)}', 2), '')), ','),
              lambda x: regexp_replace(trim(x), '^[''"]+|[''"]+$', '', 'g')),
              lambda x: x <> '' and x <> 'pg_catalog')[1] end as sp_set,
             len(regexp_extract_all(stripped, '{_q(RE_DOLLAR)}', 1)) % 2 as n
      from b where stripped <> '' and not starts_with(stripped, '--')),
l2 as (select *, sum(n) over ({_W} rows between unbounded preceding and current row) as par,
              last_value(sp_set ignore nulls) over ({_W} rows between unbounded preceding and current row) as sp
       from l),
l3 as (select *, case when par % 2 = 0 and ends_with(stripped, ';') then 1 else 0 end as is_end from l2),
l4 as (select *, cast(coalesce(sum(is_end) over ({_W} rows between unbounded preceding and 1 preceding), 0) as bigint) as stmt_no
       from l3),
st as (select instance_id, file_id, stmt_no, min(line_no) as first_line, max(line_no) as last_line,
              arg_max(sp, line_no) as search_path, string_agg(line, chr(10) order by line_no) as text
       from l4 group by instance_id, file_id, stmt_no),
stmts as (select st.instance_id, st.file_id, st.stmt_no, cast(0 as bigint) as piece, st.first_line, st.last_line, {_KIND} as kind,
                 st.search_path, ver.pg_version, st.text
          from st left join ver on ver.instance_id = st.instance_id and ver.file_id = st.file_id)"""


def _qual(name: str) -> tuple[str, str]:
    parts = f"string_split({name}, '.')"
    schema = f"case when len({parts}) > 1 then replace({parts}[1], '\"', '') else coalesce(search_path, 'public') end"
    rel = f"case when len({parts}) > 1 then replace({parts}[2], '\"', '') else replace({name}, '\"', '') end"
    return schema, rel


_ts, _tn = _qual(f"regexp_extract(text, '{_q(RE_TABLE)}', 2)")
_is, _in = _qual(f"regexp_extract(text, '{_q(RE_INDEX)}', 3)")
_INH = f"regexp_extract(text, '{_q(RE_INHERITS)}', 1)"
_PART = f"regexp_extract(text, '{_q(RE_PARTITION_BY)}', 1)"
_ON = _q(r'(?is)\bON\s+(?:ONLY\s+)?[\w".]+\s*(?:USING\s+\w+\s*)?\(([^)]*)\)')

SQL = {
    "dump_statements": f"with {STATEMENTS_CTES}\nselect * from stmts",
    "dump_tables": f"""with {STATEMENTS_CTES},
t as (select instance_id, file_id, stmt_no, {_ts} as schema_name, {_tn} as table_name,
             regexp_extract(text, '{_q(RE_TABLE)}', 1) <> '' as unlogged,
             case when {_INH} <> '' then array_to_string(list_transform(string_split({_INH}, ','),
                  lambda x: case when contains(x, '.') then replace(trim(x), '"', '') else coalesce(search_path, 'public') || '.' || replace(trim(x), '"', '') end), ',') end as inherits,
             case when {_PART} <> '' then {_PART} end as partition_by
      from stmts where kind = 'table')
select * from t where schema_name not in ({_EXCL})""",
    "dump_indexes": f"""with {STATEMENTS_CTES},
t as (select instance_id, file_id, stmt_no, {_is} as schema_name, {_in} as table_name,
             replace(regexp_extract(text, '{_q(RE_INDEX)}', 2), '"', '') as index_name,
             regexp_extract(text, '{_q(RE_INDEX)}', 1) <> '' as is_unique,
             case when regexp_extract(text, '{_q(RE_USING)}', 1) <> '' then lower(regexp_extract(text, '{_q(RE_USING)}', 1))
                  else 'btree' end as method,
             array_to_string(list_transform(string_split(regexp_extract(text, '{_ON}', 1), ','),
                  lambda x: replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '"', '')), ',') as columns
      from stmts where kind = 'index')
select * from t where schema_name not in ({_EXCL})""",
}


# dump_columns: the body split as window scans over characters (quote parity,
# parenthesis depth, top-level commas), independent of the Spark fold.

_WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_sd_s, _sd_n = _qual(f"regexp_extract(text, '{_q(RE_SET_DEFAULT)}', 1)")
_ai_s, _ai_n = _qual(f"regexp_extract(text, '{_q(RE_ADD_IDENTITY)}', 1)")
_SP = "partition by instance_id, file_id, stmt_no order by i"

_ITEMS = f"""tb as (select instance_id, file_id, stmt_no, {_ts} as schema_name, {_tn} as table_name,
              regexp_extract(text, '(?s)^[^(]*\\((.*)$', 1) as body
       from stmts where kind = 'table'),
ch as (select instance_id, file_id, stmt_no, schema_name, table_name, body, i, substr(body, i, 1) as c
       from (select *, unnest(range(1, length(body) + 1)) as i from tb) x),
q as (select *, coalesce(sum(case when c = '''' then 1 else 0 end) over ({_SP} rows between unbounded preceding
              and 1 preceding), 0) % 2 = 1 as inq from ch),
dp as (select *, coalesce(sum(case when c = '''' or inq then 0 when c = '(' then 1 when c = ')' then -1 else 0 end)
              over ({_SP} rows between unbounded preceding and 1 preceding), 0) as depth from q),
cl as (select instance_id, file_id, stmt_no, min(i) as close_i from dp
       where c = ')' and not inq and depth = 0 group by instance_id, file_id, stmt_no),
inb as (select dp.*, (dp.c = ',' and not dp.inq and dp.depth = 0) as sep from dp
        left join cl on cl.instance_id = dp.instance_id and cl.file_id = dp.file_id and cl.stmt_no = dp.stmt_no
        where dp.i < coalesce(cl.close_i, length(dp.body) + 1)),
it as (select *, sum(case when sep then 1 else 0 end) over ({_SP} rows between unbounded preceding and current row)
              as item_no from inb),
items as (select instance_id, file_id, stmt_no, schema_name, table_name, item_no,
                 {_WS.format(x="string_agg(c, '' order by i)")} as item
          from it where not sep group by instance_id, file_id, stmt_no, schema_name, table_name, item_no)"""

SQL["dump_columns"] = f"""with {STATEMENTS_CTES},
{_ITEMS},
cols as (select *, regexp_extract(item, '{_q(RE_COLUMN)}', 2) as rest from items
         where item <> '' and not regexp_matches(item, '{_q(RE_TABLE_CONSTRAINT)}')
           and regexp_matches(item, '{_q(RE_COLUMN)}') and schema_name not in ({_EXCL})),
raw as (select instance_id, file_id, stmt_no, schema_name, table_name,
               row_number() over (partition by instance_id, file_id, stmt_no order by item_no) as attnum,
               replace(regexp_extract(item, '{_q(RE_COLUMN)}', 1), '"', '') as column_name,
               {_WS.format(x=f"regexp_extract(rest, '{_q(RE_TYPE_END)}', 1)")} as data_type,
               regexp_matches(rest, '{_q(RE_NOT_NULL)}') as not_null,
               regexp_extract(rest, '{_q(RE_GENERATED)}', 1) as gen,
               regexp_extract(rest, '{_q(RE_DEFAULT)}', 1) as dflt,
               upper(regexp_replace(regexp_extract(rest, '{_q(RE_IDENTITY)}', 1), '\\s+', ' ', 'g')) as ident
        from cols),
ov as (select instance_id, file_id, schema_name, table_name, column_name,
              arg_max(default_expr, case when default_expr is not null then stmt_no end) as o_default,
              arg_max(identity, case when identity is not null then stmt_no end) as o_identity
       from (select instance_id, file_id, stmt_no,
                    case when kind = 'default' then {_sd_s} else {_ai_s} end as schema_name,
                    case when kind = 'default' then {_sd_n} else {_ai_n} end as table_name,
                    replace(case when kind = 'default' then regexp_extract(text, '{_q(RE_SET_DEFAULT)}', 2)
                            else regexp_extract(text, '{_q(RE_ADD_IDENTITY)}', 2) end, '"', '') as column_name,
                    case when kind = 'default' then regexp_extract(text, '{_q(RE_SET_DEFAULT)}', 3) end as default_expr,
                    case when kind = 'identity' then case when upper(regexp_replace(regexp_extract(text,
                         '{_q(RE_ADD_IDENTITY)}', 3), '\\s+', ' ', 'g')) = 'ALWAYS' then 'a' else 'd' end end as identity
             from stmts where kind in ('default', 'identity')) d
       group by instance_id, file_id, schema_name, table_name, column_name)
select r.instance_id, r.file_id, r.stmt_no, r.schema_name, r.table_name, cast(r.attnum as bigint) as attnum,
       r.column_name, r.data_type, r.not_null,
       case when r.gen <> '' then 's' else '' end as generated,
       case when r.gen <> '' then r.gen end as generation_expr,
       coalesce(ov.o_default, case when r.dflt <> '' and r.gen = '' and coalesce(r.ident, '') = '' then r.dflt end) as default_expr,
       coalesce(ov.o_identity, case r.ident when 'ALWAYS' then 'a' when 'BY DEFAULT' then 'd' else '' end) as identity
from raw r left join ov on ov.instance_id = r.instance_id and ov.file_id = r.file_id
  and ov.schema_name = r.schema_name and ov.table_name = r.table_name and ov.column_name = r.column_name"""



_ac_s, _ac_n = _qual(f"regexp_extract(text, '{_q(RE_ADD_CONSTRAINT)}', 1)")
_rf_s, _rf_n = _qual(f"regexp_extract(text, '{_q(RE_REFERENCES)}', 1)")


def _codes(expr: str, codes: dict, default: str | None) -> str:
    norm = f"upper(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in codes.items())
    out = f"case {norm} {whens} end"
    return f"coalesce({out}, '{default}')" if default else out


def _list(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ','), lambda x: "
            f"replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\"', '')), ',')")


_KW_COLS = _q(r"(?i)(?:PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|EXCLUDE|CHECK)\s*(?:USING\s+\w+\s*)?\(([^)]*)\)")
_REF = f"regexp_extract(text, '{_q(RE_REFERENCES)}', 1)"
_DEFER = (f"(regexp_matches(text, '{_q(RE_DEFERRABLE)}') and not regexp_matches(text, '{_q(RE_NOT_DEFERRABLE)}'))")

SQL["dump_constraints"] = f"""with {STATEMENTS_CTES},
{_ITEMS},
a as (select instance_id, file_id, stmt_no, {_ac_s} as schema_name, {_ac_n} as table_name,
             replace(regexp_extract(text, '{_q(RE_ADD_CONSTRAINT)}', 2), '"', '') as constraint_name,
             regexp_extract(text, '{_q(RE_ADD_CONSTRAINT)}', 3) as ctype, text, search_path
      from stmts where kind = 'constraint'),
i as (select it.instance_id, it.file_id, it.stmt_no, it.schema_name, it.table_name,
             case when regexp_matches(it.item, '{_q(RE_CONSTRAINT_NAME)}')
                  then replace(regexp_extract(it.item, '{_q(RE_CONSTRAINT_NAME)}', 1), '"', '') end as constraint_name,
             regexp_extract(it.item, '(?i)(PRIMARY\\s+KEY|UNIQUE|FOREIGN\\s+KEY|EXCLUDE|CHECK)', 1) as ctype,
             it.item as text, s.search_path
      from items it join stmts s on s.instance_id = it.instance_id and s.file_id = it.file_id
        and s.stmt_no = it.stmt_no
      where it.item <> '' and regexp_matches(it.item, '{_q(RE_TABLE_CONSTRAINT)}')),
u as (select * from a union all select * from i),
c as (select instance_id, file_id, stmt_no, schema_name, table_name, constraint_name,
             {_codes('ctype', CONTYPE_CODES, None)} as contype,
             {_list(f"regexp_extract(text, '{_KW_COLS}', 1)")} as columns,
             case when {_REF} <> '' then {_rf_s} || '.' || {_rf_n} end as ref_table,
             case when {_REF} <> '' then {_list(f"regexp_extract(text, '{_q(RE_REFERENCES)}', 2)")} end as ref_columns,
             case when {_REF} <> '' then {_codes(f"regexp_extract(text, '{_q(RE_ON_DELETE)}', 1)", FK_ACTION_CODES, 'a')}
                  end as on_delete,
             case when {_REF} <> '' then {_codes(f"regexp_extract(text, '{_q(RE_ON_UPDATE)}', 1)", FK_ACTION_CODES, 'a')}
                  end as on_update,
             {_DEFER} as deferrable,
             {_DEFER} and regexp_matches(text, '{_q(RE_INITIALLY_DEFERRED)}') as deferred
      from u where ctype <> '')
select * replace (case when contype = 'c' then '' else columns end as columns) from c where schema_name not in ({_EXCL})"""


# sequences, ALTER COLUMN overrides, extensions, enums, rules

_sq_s, _sq_n = _qual(f"regexp_extract(text, '{_q(RE_SEQUENCE)}', 1)")
_ow_s, _ow_n = _qual(f"regexp_extract(text, '{_q(RE_SEQ_OWNED)}', 1)")
_ot_s, _ot_n = _qual(f"regexp_extract(text, '{_q(RE_SEQ_OWNED)}', 2)")
_en_s, _en_n = _qual(f"regexp_extract(text, '{_q(RE_ENUM)}', 1)")
_ru_s, _ru_n = _qual(f"regexp_extract(text, '{_q(RE_RULE)}', 3)")


def _opt(name: str) -> str:
    x = f"regexp_extract(text, '{_q(SEQ_OPTIONS[name])}', 1)"
    return f"case when {x} <> '' then cast({x} as bigint) end as {name}"


_DT = f"regexp_extract(text, '{_q(SEQ_OPTIONS['data_type'])}', 1)"
_EXT_SCH = f"regexp_extract(text, '{_q(RE_EXTENSION)}', 2)"

SQL["dump_sequences"] = f"""with {STATEMENTS_CTES},
s as (select instance_id, file_id, {_sq_s} as schema_name, {_sq_n} as sequence_name,
             case when {_DT} <> '' then lower({_DT}) else 'bigint' end as data_type,
             {_opt('start_value')}, {_opt('increment')}, {_opt('min_value')}, {_opt('max_value')},
             regexp_matches(text, '(?i)\\bCYCLE\\b') and not regexp_matches(text, '(?i)\\bNO\\s+CYCLE\\b') as is_cycle
      from stmts where kind = 'sequence'),
o as (select instance_id, file_id, {_ow_s} as schema_name, {_ow_n} as sequence_name,
             {_ot_s} || '.' || {_ot_n} as owner_table,
             replace(regexp_extract(text, '{_q(RE_SEQ_OWNED)}', 3), '"', '') as owner_column, stmt_no
      from stmts where kind = 'owned_by'),
og as (select instance_id, file_id, schema_name, sequence_name, arg_max(owner_table, stmt_no) as owner_table,
              arg_max(owner_column, stmt_no) as owner_column
       from o group by instance_id, file_id, schema_name, sequence_name)
select s.*, og.owner_table, og.owner_column from s left join og on og.instance_id = s.instance_id
  and og.file_id = s.file_id and og.schema_name = s.schema_name and og.sequence_name = s.sequence_name
where s.schema_name not in ({_EXCL})"""

SQL["dump_defaults_identity"] = f"""with {STATEMENTS_CTES},
d as (select instance_id, file_id, stmt_no,
             case when kind = 'default' then {_sd_s} else {_ai_s} end as schema_name,
             case when kind = 'default' then {_sd_n} else {_ai_n} end as table_name,
             replace(case when kind = 'default' then regexp_extract(text, '{_q(RE_SET_DEFAULT)}', 2)
                     else regexp_extract(text, '{_q(RE_ADD_IDENTITY)}', 2) end, '"', '') as column_name,
             case when kind = 'default' then regexp_extract(text, '{_q(RE_SET_DEFAULT)}', 3) end as default_expr,
             case when kind = 'identity' then case when upper(regexp_replace(regexp_extract(text,
                  '{_q(RE_ADD_IDENTITY)}', 3), '\\s+', ' ', 'g')) = 'ALWAYS' then 'a' else 'd' end end as identity
      from stmts where kind in ('default', 'identity'))
select instance_id, file_id, schema_name, table_name, column_name,
       arg_max(default_expr, case when default_expr is not null then stmt_no end) as default_expr,
       arg_max(identity, case when identity is not null then stmt_no end) as identity
from d group by instance_id, file_id, schema_name, table_name, column_name"""

SQL["dump_extensions"] = f"""with {STATEMENTS_CTES}
select instance_id, file_id,
       regexp_replace(replace(regexp_extract(text, '{_q(RE_EXTENSION)}', 1), '"', ''), ';$', '') as extension_name,
       case when {_EXT_SCH} <> '' then regexp_replace(replace({_EXT_SCH}, '"', ''), ';$', '') else 'public' end
         as schema_name
from stmts where kind = 'extension'"""

SQL["dump_enums"] = f"""with {STATEMENTS_CTES},
e as (select instance_id, file_id, {_en_s} as schema_name, {_en_n} as type_name,
             regexp_extract_all(regexp_extract(text, '(?is)AS\\s+ENUM\\s*\\((.*)\\)', 1), '''((?:[^'']|'''')*)''', 1)
               as labels
      from stmts where kind = 'enum')
select instance_id, file_id, schema_name, type_name, cast(len(labels) as bigint) as label_count,
       array_to_string(list_transform(labels, lambda x: replace(x, '''''', '''')), ',') as labels
from e where schema_name not in ({_EXCL})"""

SQL["dump_rules"] = f"""with {STATEMENTS_CTES},
r as (select instance_id, file_id, {_ru_s} as schema_name, {_ru_n} as table_name,
             replace(regexp_extract(text, '{_q(RE_RULE)}', 1), '"', '') as rule_name,
             upper(regexp_extract(text, '{_q(RE_RULE)}', 2)) as event,
             regexp_extract(text, '{_q(RE_RULE)}', 4) <> '' as is_instead
      from stmts where kind = 'rule')
select * from r where schema_name not in ({_EXCL})"""
