"""Offline audit of schema dumps (the reference's ``analyze`` mode).

Dump facts (``fleetlint.plans.dump``) are reshaped into catalog-shaped
tables, so the same check transforms run on them:

* object ids are 64-bit hashes of the qualified names (``xxhash64``), unique
  inside an instance like catalog oids;
* column references of constraints and indexes become ``attnum`` arrays by a
  join with the table's columns (groups bounded by a key's column count);
* PRIMARY KEY / UNIQUE constraints also appear as unique indexes (a dump
  declares them as constraints, the server backs them with indexes).

Only checks flagged ``offline`` run; offline differences of the reference
are switched on by ``catalog.source == "dump"`` inside those checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relops import ordered_array_agg
from ..sources.catalog import Catalog
from . import dump as D
from .report import Run, check_status, run_isolated

# Rule event names to catalog codes.
RULE_EVENT_CODES = {"SELECT": "1", "UPDATE": "2", "INSERT": "3", "DELETE": "4"}


def _oid(*parts) -> F.Column:
    return F.xxhash64(*parts)


def catalog_from_dump(spark: SparkSession, lines: DataFrame, keys: list[str] | None = None,
                      file_col: str = "file_id") -> Catalog:
    """Catalog of dump facts; the file is a scope key, so several dumps of one instance stay apart."""
    base = list(keys or ["instance_id"])
    k = [*base, file_col]
    stmts = D.dump_statements(lines, base, file_col)
    tables = D.dump_tables(stmts, base, file_col, lists=True)
    columns = D.dump_columns(stmts, base, file_col)
    cons = D.dump_constraints(stmts, base, file_col, lists=True)
    idx = D.dump_indexes(stmts, base, file_col, lists=True)
    seqs = D.dump_sequences(stmts, base, file_col, lists=True)
    enums = D.enum_labels(stmts, base, file_col)
    rules = D.dump_rules(stmts, base, file_col)
    exts = D.dump_extensions(stmts, base, file_col)

    def t_oid(schema="schema_name", table="table_name"):
        return _oid(F.col(schema), F.col(table))

    def namespaces():
        names = (tables.select(*k, "schema_name").unionByName(seqs.select(*k, "schema_name"))
                 .unionByName(enums.select(*k, "schema_name")).distinct())
        return names.select(*k, _oid(F.col("schema_name")).alias("oid"), F.col("schema_name").alias("nspname"))

    def classes():
        return tables.select(*k, t_oid().alias("oid"), _oid(F.col("schema_name")).alias("relnamespace"),
                             F.col("table_name").alias("relname"),
                             F.when(F.col("partition_by").isNotNull(), F.lit("p")).otherwise(F.lit("r")).alias("relkind"),
                             F.when(F.col("unlogged"), F.lit("u")).otherwise(F.lit("p")).alias("relpersistence"),
                             F.lit(False).alias("relrowsecurity"), F.lit(False).alias("relforcerowsecurity"),
                             F.lit(0).alias("reltablespace"))

    def attributes():
        return columns.select(*k, t_oid().alias("attrelid"), "attnum", F.col("column_name").alias("attname"),
                              F.col("data_type").alias("atttype"), F.col("not_null").alias("attnotnull"),
                              F.col("generated").alias("attgenerated"),
                              F.col("identity").alias("attidentity"),
                              F.coalesce("default_expr", "generation_expr").alias("default_expr"))

    col_pos = columns.select(*k, t_oid().alias("relid"), F.col("column_name").alias("cname"), "attnum")

    def attnums(df: DataFrame, id_cols: list[str], rel: str, names: str, out: str) -> DataFrame:
        """Column-name array -> attnum array in list order; an expression or unknown name keeps its place as 0."""
        ex = df.select(*k, *id_cols, rel, F.posexplode(names).alias("pos", "cname"))
        j = ex.join(col_pos.withColumnRenamed("relid", rel), k + [rel, "cname"], "left")
        return j.groupBy(*k, *id_cols, rel).agg(ordered_array_agg(F.coalesce("attnum", F.lit(0).cast("bigint")), "pos").alias(out))

    def constraints():
        c = cons.select(*k, "constraint_name", "contype", "column_list", "on_delete", "on_update", "deferrable", "deferred",
                        t_oid().alias("conrelid"), F.when(F.col("ref_name").isNotNull(), _oid("ref_schema", "ref_name")).alias("confrelid"),
                        _oid(F.col("schema_name"), F.col("table_name"), F.coalesce("constraint_name", F.lit("")))
                        .alias("oid"))
        named = c.filter(F.size("column_list") > 0)
        keys_ = attnums(named, ["oid"], "conrelid", "column_list", "conkey")
        c = c.join(keys_, k + ["oid", "conrelid"], "left")
        return c.select(*k, "oid", "conrelid", F.col("constraint_name").alias("conname"), "contype",
                        F.coalesce("conkey", F.array().cast("array<bigint>")).alias("conkey"), "confrelid",
                        F.col("deferrable").alias("condeferrable"), F.col("deferred").alias("condeferred"),
                        F.coalesce("on_delete", F.lit("a")).alias("confdeltype"),
                        F.coalesce("on_update", F.lit("a")).alias("confupdtype"))

    def indexes():
        i = idx.select(*k, t_oid().alias("indrelid"), "index_name", "is_unique", "column_list")
        keys_ = attnums(i, ["index_name"], "indrelid", "column_list", "indkey")
        i = i.join(keys_, k + ["index_name", "indrelid"]).select(
            *k, "indrelid", F.col("index_name").alias("indexname"), "indkey", F.col("is_unique").alias("indisunique"))
        c = constraints().filter(F.col("contype").isin("p", "u") & (F.size("conkey") > 0)).select(
            *k, F.col("conrelid").alias("indrelid"), F.col("conname").alias("indexname"),
            F.col("conkey").alias("indkey"), F.lit(True).alias("indisunique"))
        return i.unionByName(c)

    def sequences():
        s = seqs.withColumn("refobjid", F.when(F.col("owner_name").isNotNull(), _oid("owner_schema", "owner_name")))
        s = s.join(col_pos.select(*k, F.col("relid").alias("refobjid"), F.col("cname").alias("owner_column"),
                                  F.col("attnum").alias("refobjsubid")), k + ["refobjid", "owner_column"], "left")
        return s.select(*k, _oid(F.col("schema_name")).alias("relnamespace"), F.col("sequence_name").alias("relname"),
                        "data_type", F.col("start_value").alias("seqstart"),
                        F.coalesce("increment", F.lit(1)).alias("seqincrement"),
                        F.coalesce("max_value", F.when(F.col("data_type") == "smallint", F.lit(32767))
                                   .when(F.col("data_type") == "integer", F.lit(2147483647))
                                   .otherwise(F.lit(9223372036854775807))).alias("seqmax"),
                        F.col("is_cycle").alias("seqcycle"), "refobjid", "refobjsubid")

    def enum_labels():
        e = enums.select(*k, "schema_name", "type_name", F.posexplode("label_list").alias("pos", "enumlabel"))
        return e.select(*k, _oid(F.col("schema_name")).alias("typnamespace"), F.col("type_name").alias("typname"),
                        "enumlabel", (F.col("pos") + 1).cast("bigint").alias("enumsortorder"))

    def rewrite():
        m = F.create_map(*[x for kv in RULE_EVENT_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        return rules.select(*k, t_oid().alias("ev_class"), F.col("rule_name").alias("rulename"),
                            F.coalesce(F.element_at(m, F.col("event")), F.col("event")).alias("ev_type"), "is_instead")

    def inherits():
        t = tables.select(*k, t_oid().alias("inhrelid"), F.explode("parent_list").alias("p"))
        return t.select(*k, "inhrelid", _oid("p.schema_name", "p.table_name").alias("inhparent"))

    def extensions():
        return exts.select(*k, F.col("extension_name").alias("extname"),
                           F.lit(None).cast("string").alias("extversion"),
                           F.lit(None).cast("string").alias("default_version"), F.lit(True).alias("installed"))

    def settings():
        v = stmts.select(*k, "pg_version").filter(F.col("pg_version").isNotNull()).distinct()
        major = F.regexp_extract("pg_version", r"^(\d+)", 1)
        minor = F.regexp_extract("pg_version", r"^\d+\.(\d+)", 1)
        num = major.cast("bigint") * 10000 + F.coalesce(F.nullif(minor, F.lit("")).cast("bigint"), F.lit(0))
        return v.filter(major != "").select(*k, F.lit("server_version_num").alias("name"),
                                            num.cast("string").alias("setting"))

    def instances():
        return lines.select(*k).distinct().withColumn("cluster_id", F.lit(None).cast("string"))

    def largeobjects():
        return instances().select(*k).limit(0).withColumn("oid", F.lit(0).cast("bigint"))

    loaders = {"cat_namespace": namespaces, "cat_class": classes, "cat_attribute": attributes,
               "cat_constraint": constraints, "cat_index": indexes, "cat_sequence": sequences,
               "cat_enum": enum_labels, "cat_rewrite": rewrite, "cat_inherits": inherits,
               "cat_extension": extensions, "settings": settings, "instances": instances,
               "cat_largeobject": largeobjects}
    cat = Catalog(spark, loaders, keys=k)
    cat.source = "dump"
    return cat


def offline_checks():
    from ..checks.registry import select_checks
    return [s for s in select_checks() if s.offline]


def analyze_run(cat: Catalog) -> Run:
    """A run of the offline checks over a dump catalog; each check is a job of its own over tables that are
    derived from the dump once."""
    return run_isolated(cat, include_only=[s.name for s in offline_checks()])


def analyze_findings(cat: Catalog) -> DataFrame:
    """Findings of the offline checks over a dump catalog (others are skipped); a failed check raises ``ChecksFailed``."""
    return analyze_run(cat).whole()


def analyze_check_status(cat: Catalog, findings: DataFrame | None = None, errors: dict | None = None) -> DataFrame:
    """Status per check; the live-only checks are skipped with reason ``live only``.  Given ``findings`` of a run in
    which checks failed need its ``errors``; without findings the checks are run and a failed one is an error."""
    if findings is None:
        run = analyze_run(cat)
        findings, errors = run.findings, run.errors
    st = check_status(cat, findings, errors=errors)
    offline = [s.name for s in offline_checks()]
    return st.withColumn("skip_reason", F.when(~F.col("check_name").isin(*offline), F.lit("live only"))
                         .otherwise(F.col("skip_reason"))) \
             .withColumn("status", F.when(~F.col("check_name").isin(*offline), F.lit("skipped"))
                         .otherwise(F.col("status")))
