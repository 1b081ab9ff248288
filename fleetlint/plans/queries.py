"""Named queries of the non-check operators (report rollups, relational
core, schema-dump facts, activity) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks.registry import select_checks
from ..oracles.checks_sql import SQL as CHECK_SQL
from ..sources.catalog import Catalog
from . import report

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
# queries whose result has no instance_id column (fleet-wide rollups)
NO_INSTANCE_COLUMN: set[str] = {"fleet_verdicts"}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# -- report rollups over all 57 checks --------------------------------
def _all_findings_sql() -> str:
    parts = []
    for i, s in enumerate(select_checks()):
        parts.append(f"select cast(instance_id as bigint) as instance_id, '{s.name}' as check_name, "
                     f"'{s.category}' as category, severity, object_name, "
                     f"({report.remediation_rule(s.name)}) as has_rem from ({CHECK_SQL[s.name]}) q{i}")
    return "af as (\n" + "\nunion all\n".join(parts) + ")"


_RANK = "case severity when 'CRITICAL' then 0 when 'WARNING' then 1 when 'CONSIDER' then 2 else 3 end"
_COUNTS = """sc as (select cast(i.instance_id as bigint) as instance_id,
  count(af.severity) filter (where af.severity = 'CRITICAL') as critical,
  count(af.severity) filter (where af.severity = 'WARNING') as warning,
  count(af.severity) filter (where af.severity = 'CONSIDER') as consider,
  count(af.severity) filter (where af.severity = 'INFO') as info
  from instances i left join af on af.instance_id = i.instance_id group by i.instance_id)"""
_VERDICT = ("case when critical = 0 and warning = 0 then 'READY' when critical = 0 then 'CONDITIONALLY READY' "
            "else 'NOT READY' end")


def _findings(spark, sf_dir):
    cat = Catalog.from_fixtures(spark, sf_dir)
    return cat, report.run_isolated(cat).whole()


def _register_reports() -> None:
    af = _all_findings_sql()

    @query("severity_counts", f"with {af},\n{_COUNTS}\nselect * from sc")
    def severity_counts(spark, sf_dir):
        """Findings per severity per instance over all checks."""
        cat, f = _findings(spark, sf_dir)
        return report.severity_counts(cat, f)

    @query("verdict", f"with {af},\n{_COUNTS}\nselect *, {_VERDICT} as verdict from sc")
    def verdict(spark, sf_dir):
        """Readiness verdict per instance from its severity counts."""
        cat, f = _findings(spark, sf_dir)
        return report.verdict(report.severity_counts(cat, f))

    @query("fleet_verdicts", f"""with {af},\n{_COUNTS},
v(verdict) as (values ('READY'), ('CONDITIONALLY READY'), ('NOT READY')),
c as (select {_VERDICT} as verdict, count(*) as n from sc group by 1)
select v.verdict, coalesce(c.n, 0) as instances from v left join c on c.verdict = v.verdict""")
    def fleet_verdicts(spark, sf_dir):
        """Number of instances per verdict."""
        cat, f = _findings(spark, sf_dir)
        return report.fleet_verdicts(report.verdict(report.severity_counts(cat, f)))

    checks_values = ", ".join(f"('{s.name}', '{s.category}')" for s in select_checks())

    @query("check_status", f"""with {af},
ck(check_name, category) as (values {checks_values}),
cnt as (select instance_id, check_name, count(*) as n from af group by instance_id, check_name)
select cast(i.instance_id as bigint) as instance_id, ck.check_name, ck.category,
       case when coalesce(cnt.n, 0) > 0 then 'failed' else 'passed' end as status,
       coalesce(cnt.n, 0) as finding_count, cast(null as varchar) as skip_reason, cast(null as varchar) as error
from instances i cross join ck
left join cnt on cnt.instance_id = i.instance_id and cnt.check_name = ck.check_name""")
    def check_status(spark, sf_dir):
        """Per instance and check: passed, failed (has findings), error or skipped (missing input)."""
        cat = Catalog.from_fixtures(spark, sf_dir)
        run = report.run_isolated(cat)
        return report.check_status(cat, run.findings, errors=run.errors)

    @query("findings_grouped", f"""with {af}
select instance_id, {_RANK} as severity_rank, severity, category, count(*) as finding_count
from af group by all""")
    def findings_grouped(spark, sf_dir):
        """Findings counted by severity and category per instance."""
        cat, f = _findings(spark, sf_dir)
        return report.findings_grouped(cat, f)

    @query("todo_list", f"""with {af}
select instance_id, severity, {_RANK} as severity_rank, check_name, category, object_name
from af where severity in ('CRITICAL', 'WARNING') and has_rem""")
    def todo_list(spark, sf_dir):
        """CRITICAL and WARNING findings that carry a remediation (text column left out for the oracle)."""
        cat, f = _findings(spark, sf_dir)
        return report.todo_list(f).drop("remediation")


_register_reports()


# -- activity ------------------------------------------------------------
def _register_activity() -> None:
    from ..checks import sql_patterns
    from ..oracles import activity as osql
    from . import activity as act

    def keyed(fn):
        def run(spark, sf_dir):
            cat = Catalog.from_fixtures(spark, sf_dir)
            return fn(cat)
        run.__doc__ = fn.__doc__
        return run

    QUERIES["pattern_statements"] = keyed(lambda cat: sql_patterns.pattern_statements(cat))
    QUERIES["stmt_key"] = keyed(lambda cat: act.stmt_keyed(cat["stat_statements"], cat.keys))
    QUERIES["stmt_delta"] = keyed(lambda cat: act.stmt_delta(cat["stat_statements"], cat.keys))
    QUERIES["stmt_delta_findings"] = keyed(lambda cat: act.stmt_delta_findings(cat["stat_statements"], cat.keys))
    QUERIES["log_assemble"] = keyed(lambda cat: act.log_assemble(cat["log_lines"], cat.keys))
    QUERIES["log_classify"] = keyed(lambda cat: act.log_classify(act.log_assemble(cat["log_lines"], cat.keys))
                                    .select("instance_id", "file_id", "entry_no", "line_no", "class"))
    QUERIES["log_findings"] = keyed(lambda cat: act.log_findings(act.log_assemble(cat["log_lines"], cat.keys),
                                                                 cat.keys))
    QUERIES["monitor_findings"] = keyed(lambda cat: act.monitor_findings(cat).drop("metadata").withColumn("severity_rank", F.col("severity_rank").cast("bigint")))
    QUERIES["monitor_todo"] = keyed(lambda cat: report.todo_list(act.monitor_findings(cat), severities=["WARNING", "INFO"]))
    ORACLES.update(osql.SQL)


_register_activity()


# -- the reusable relational operators -------------------------
def _register_relops() -> None:
    from ..checks.functions import WRITE_PATTERNS
    from ..checks.schema import FK_ACTION_LABELS, VOLATILE_DEFAULT_PATTERNS
    from ..checks.settings import setting_evaluations
    from ..checks.sql_patterns import STATEMENT_PATTERNS, classify_statements
    from ..oracles import any_contains, label_case
    from ..operators import relops as R

    def q(name, oracle):
        def deco(fn):
            def run(spark, sf_dir):
                return fn(Catalog.from_fixtures(spark, sf_dir))
            run.__doc__ = fn.__doc__
            QUERIES[name] = run
            ORACLES[name] = oracle
            return fn
        return deco

    @q("r_prefix_cover_anti", """
select k.instance_id, k.conrelid, k.conname, array_to_string(k.conkey, ',') as conkey
from cat_constraint k where k.contype = 'f' and not exists (
  select 1 from cat_index i where i.instance_id = k.instance_id and i.indrelid = k.conrelid
    and len(i.indkey) >= len(k.conkey) and i.indkey[1:len(k.conkey)] = k.conkey)""")
    def prefix_cover(cat):
        """Foreign keys whose columns are not the leading columns of any index on the table."""
        k = cat.keys
        fk = cat["cat_constraint"].filter(F.col("contype") == "f").select(*k, "conrelid", "conname", "conkey")
        out = R.prefix_cover_anti(fk, cat["cat_index"], k + ["conrelid"], k + ["indrelid"], "conkey", "indkey")
        return out.select(F.col("instance_id").cast("bigint"), "conrelid", "conname",
                          F.array_join("conkey", ",").alias("conkey"))

    @q("r_ordered_array_agg", """
with ex as (select instance_id, conrelid, conname, unnest(conkey) as attnum, generate_subscripts(conkey, 1) as pos
            from cat_constraint where contype in ('p', 'u'))
select e.instance_id, e.conrelid, e.conname, string_agg(a.attname, ',' order by e.pos) as columns
from ex e join cat_attribute a on a.instance_id = e.instance_id and a.attrelid = e.conrelid and a.attnum = e.attnum
group by e.instance_id, e.conrelid, e.conname""")
    def ordered_agg(cat):
        """Column names of every PRIMARY KEY / UNIQUE constraint in key order (unnest with ordinality)."""
        k = cat.keys
        c = (cat["cat_constraint"].filter(F.col("contype").isin("p", "u"))
             .select(*k, "conrelid", "conname", F.posexplode("conkey").alias("pos", "attnum")))
        a = cat["cat_attribute"].select(*k, F.col("attrelid").alias("conrelid"), "attnum", "attname")
        g = c.join(a, k + ["conrelid", "attnum"]).groupBy(*k, "conrelid", "conname").agg(
            F.array_join(R.ordered_array_agg("attname", "pos"), ",").alias("columns"))
        return g.withColumn("instance_id", F.col("instance_id").cast("bigint"))

    @q("r_correlated_count", """
select c.instance_id, c.oid, c.relname,
       (select count(*) from cat_policy p where p.instance_id = c.instance_id and p.polrelid = c.oid) as policy_count,
       (select count(*) from cat_inherits i where i.instance_id = c.instance_id and i.inhparent = c.oid) as child_count
from cat_class c""")
    def corr_count(cat):
        """Per relation: number of policies and of inheriting children (scalar subquery counts)."""
        k = cat.keys
        c = cat["cat_class"].select(*k, "oid", "relname")
        c = R.correlated_count(c, cat["cat_policy"], k + ["oid"], k + ["polrelid"], "policy_count")
        c = R.correlated_count(c, cat["cat_inherits"], k + ["oid"], k + ["inhparent"], "child_count")
        return c.withColumn("instance_id", F.col("instance_id").cast("bigint"))

    @q("r_topk", """
select * from (
  select instance_id, table_name, count(*) as conflicts,
         row_number() over (partition by instance_id order by count(*) desc, table_name) as rank
  from conflict_history group by instance_id, table_name) x
where rank <= 5""")
    def top_k(cat):
        """The five tables with most conflicts per instance (top-k report; ties by name)."""
        k = cat.keys
        g = cat["conflict_history"].groupBy(*k, "table_name").agg(F.count(F.lit(1)).alias("conflicts"))
        t = R.topk(g, k, [F.col("conflicts").desc(), F.col("table_name").asc()], 5, "rank")
        return t.select(F.col("instance_id").cast("bigint"), "table_name", "conflicts",
                        F.col("rank").cast("bigint"))

    @q("r_group_list_preview", """
with x as (select instance_id, typname, enumlabel, enumsortorder,
                  row_number() over (partition by instance_id, typname order by enumsortorder) as rn from cat_enum)
select instance_id, typname, count(*) as label_count,
       string_agg(case when rn <= 20 then enumlabel end, ',' order by rn) as kept,
       string_agg(case when rn <= 10 then enumlabel end, ', ' order by rn) || case when count(*) > 10 then '...' else '' end
         as preview
from x group by instance_id, typname""")
    def list_preview(cat):
        """Per enum type name: label count, first 20 labels kept, first 10 shown."""
        k = cat.keys
        g = R.group_list_preview(cat["cat_enum"], k + ["typname"], "enumlabel", [F.col("enumsortorder")], 10, 20)
        return g.select(F.col("instance_id").cast("bigint"), "typname", F.col("count").cast("bigint").alias("label_count"),
                        F.array_join("kept", ",").alias("kept"), "preview")

    @q("r_code_labels", f"""
select instance_id, oid, {label_case('confdeltype', FK_ACTION_LABELS)} as on_delete,
       {label_case('confupdtype', FK_ACTION_LABELS)} as on_update
from cat_constraint where contype = 'f'""")
    def labels(cat):
        """FK action codes as labels (unknown codes fall back to the code)."""
        c = cat["cat_constraint"].filter(F.col("contype") == "f")
        return c.select(F.col("instance_id").cast("bigint"), "oid",
                        R.code_labels("confdeltype", FK_ACTION_LABELS).alias("on_delete"),
                        R.code_labels("confupdtype", FK_ACTION_LABELS).alias("on_update"))

    @q("r_keyword_any", f"""
select instance_id, attrelid, attnum, {any_contains('lower(default_expr)', VOLATILE_DEFAULT_PATTERNS)} as volatile
from cat_attribute where default_expr is not null""")
    def kw_any(cat):
        """Whether each column default contains any volatile-function keyword."""
        a = cat["cat_attribute"].filter(F.col("default_expr").isNotNull())
        return a.select(F.col("instance_id").cast("bigint"), "attrelid", "attnum",
                        R.keyword_any("default_expr", VOLATILE_DEFAULT_PATTERNS).alias("volatile"))

    hits = ", ".join(f"case when contains(upper(prosrc), '{p}') then '{p}' end" for p in WRITE_PATTERNS)

    @q("r_keyword_all_hits", f"""
select instance_id, oid, concat_ws('|', {hits}) as hits from cat_proc""")
    def kw_all(cat):
        """Every write phrase each function body contains, in phrase order."""
        p = cat["cat_proc"]
        return p.select(F.col("instance_id").cast("bigint"), "oid",
                        F.array_join(R.keyword_all_hits("prosrc", WRITE_PATTERNS), "|").alias("hits"))

    cls = ", ".join(f"case when regexp_matches(query, '{rx}') then '{c}' end" for c, rx in STATEMENT_PATTERNS)

    @q("r_regex_scan", f"""
select instance_id, snapshot_no, query, calls, concat_ws(',', {cls}) as classes from cur_stmt""")
    def regex_scan(cat):
        """Pattern classes of every statement of the newest snapshot, in one pass over the text."""
        s = classify_statements(cat)
        return s.select(F.col("instance_id").cast("bigint"), "snapshot_no", "query", "calls",
                        F.array_join("classes", ",").alias("classes"))

    from ..checks.settings import SETTING_RULES
    rules = ", ".join(f"('{c}', '{n}', '{o}', '{t}', '{s}')" for c, n, o, t, s in SETTING_RULES)

    @q("r_setting_rule", f"""
with r(check_name, name, op, target, fail_severity) as (values {rules})
select s.instance_id, r.check_name, s.name, s.setting as value, r.fail_severity,
       coalesce(case r.op when 'eq' then s.setting <> r.target when 'ne' then s.setting = r.target
                when 'min' then try_cast(s.setting as bigint) < cast(r.target as bigint) end, false) as violated
from settings s join r on r.name = s.name""")
    def setting_rule(cat):
        """Every setting with a rule, evaluated against it (one join with the broadcast rule table)."""
        e = setting_evaluations(cat)
        return e.select(F.col("instance_id").cast("bigint"), "check_name", "name", "value", "fail_severity",
                        "violated")


_register_relops()


# -- schema-dump facts ----------------------------------------------------------
def _register_dump() -> None:
    from . import dump as D

    def stmts(cat):
        return D.dump_statements(cat["dump_lines"], cat.keys)

    def reg(name, fn):
        def run(spark, sf_dir):
            cat = Catalog.from_fixtures(spark, sf_dir)
            return fn(cat)
        run.__doc__ = (fn.__doc__ or "") or name
        QUERIES[name] = run

    reg("dump_statements", stmts)
    for name in ("dump_tables", "dump_columns", "dump_constraints", "dump_indexes", "dump_sequences",
                 "dump_defaults_identity", "dump_extensions", "dump_enums", "dump_rules"):
        fn = getattr(D, name)
        reg(name, (lambda f: lambda cat: f(stmts(cat), cat.keys))(fn))


_register_dump()


# -- offline audit of schema dumps (analyze) ----------------------------------------------------
def _register_analyze() -> None:
    from . import analyze as AZ

    def dump_cat(spark, sf_dir):
        return AZ.catalog_from_dump(spark, Catalog.from_fixtures(spark, sf_dir)["dump_lines"])

    def analyze_findings(spark, sf_dir):
        """Findings of the 19 offline checks over the schema dumps (texts and metadata left out for the oracle)."""
        return AZ.analyze_findings(dump_cat(spark, sf_dir)).drop("title", "detail", "remediation", "metadata").withColumn(
            "severity_rank", F.col("severity_rank").cast("bigint"))

    def analyze_check_status(spark, sf_dir):
        """Per dump and check: passed / failed / skipped (live-only checks)."""
        return AZ.analyze_check_status(dump_cat(spark, sf_dir))

    QUERIES["analyze_findings"] = analyze_findings
    QUERIES["analyze_check_status"] = analyze_check_status
    from ..oracles import analyze as osql
    ORACLES["analyze_findings"] = osql.FINDINGS
    ORACLES["analyze_check_status"] = osql.status([(s.name, s.category) for s in select_checks()])


_register_analyze()
