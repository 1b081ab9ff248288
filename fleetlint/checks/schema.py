"""Schema checks as fleet-wide DataFrame transforms.

Every join carries the scope keys; relation ids (``oid``) are unique only
inside an instance/snapshot.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import cut, qualify
from ..operators.relops import (code_labels, correlated_count, group_list_preview,
                                keyword_any, ordered_array_agg, prefix_cover_anti)
from .common import CONSIDER, CRITICAL, INFO, WARNING, current_statements, facts_frame, sev
from .registry import register_check

# Fixed values (rule tables of the schema checks) -------------------------------
FK_ACTION_LABELS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
CONSTRAINT_TYPE_LABELS = {"p": "PRIMARY KEY", "u": "UNIQUE"}
RULE_EVENT_LABELS = {"1": "SELECT", "2": "UPDATE", "3": "INSERT", "4": "DELETE"}
PARTITION_STRATEGY_LABELS = {"r": "RANGE", "l": "LIST", "h": "HASH"}
RELKIND_LABELS = {"r": "table", "i": "index", "m": "materialized view"}
EVENT_TRIGGER_ENABLED_LABELS = {"O": "origin/local", "D": "disabled", "R": "replica", "A": "always"}
GENERATED_LABELS = {"s": "STORED", "v": "VIRTUAL"}
VOLATILE_DEFAULT_PATTERNS = [
    "now()", "current_timestamp", "current_date", "current_time",
    "clock_timestamp()", "statement_timestamp()", "transaction_timestamp()",
    "timeofday()", "random()", "gen_random_uuid()", "uuid_generate_",
    "pg_current_xact_id()",
]
COUNTER_NAME_PATTERNS = [
    "count", "total", "sum", "balance", "quantity", "qty",
    "amount", "tally", "counter", "num_", "cnt", "running_",
    "cumulative", "aggregate", "accrued", "inventory",
]
NUMERIC_TYPES = ["integer", "bigint", "smallint", "numeric", "real", "double precision"]
NOTIFY_REGEX = r"(?i)pg_notify|\bnotify\b"
TEMP_TABLE_REGEX = r"(?i)CREATE\s+(TEMP|TEMPORARY)\s+TABLE"


def _s(name: str):
    return lambda: F.col(name)


def _no_pk_tables(cat):
    pk = (cat["cat_constraint"].filter(F.col("contype") == "p")
          .select(*cat.keys, F.col("conrelid").alias("oid")))
    return cat.user_classes("r").join(pk, cat.keys + ["oid"], "left_anti")


@register_check("primary_keys", "schema", needs=("cat_class", "cat_namespace", "cat_constraint"),
                description="Tables without primary keys - affects replication behaviour",
                title=lambda: F.format_string("%s: no primary key", F.col("object_name")),
                remediation=lambda: F.format_string(
                    "Add a primary key to '%s' if UPDATE/DELETE replication is needed; "
                    "insert-only tables replicate through the insert-only set.", F.col("object_name")),
                offline=True)
def primary_keys(cat):
    t = _no_pk_tables(cat)
    return facts_frame(t, cat.keys, F.col("fqn"), F.lit(WARNING))


@register_check("tables_update_delete_no_pk", "schema",
                needs=("cat_class", "cat_namespace", "cat_constraint", "cat_table_stats"),
                description="Tables without a primary key that receive UPDATE/DELETE traffic",
                title=lambda: F.when(F.col("severity") == CRITICAL, F.format_string(
                    "%s: rows are updated or deleted, and no primary key tells them apart", F.col("object_name")))
                .otherwise(F.format_string("%s: no primary key, but rows are only inserted",
                                           F.col("object_name"))),
                remediation=lambda: F.when(F.col("severity") == CRITICAL, F.format_string(
                    "Add a primary key to '%s', or set REPLICA IDENTITY FULL.", F.col("object_name"))))
def tables_update_delete_no_pk(cat):
    st = cat["cat_table_stats"].select(*cat.keys, F.col("relid").alias("oid"),
                                        "n_tup_ins", "n_tup_upd", "n_tup_del")
    t = _no_pk_tables(cat).join(st, cat.keys + ["oid"])
    s = sev(((F.col("n_tup_upd") + F.col("n_tup_del")) > 0, CRITICAL), (F.col("n_tup_ins") > 0, INFO))
    out = facts_frame(t, cat.keys, F.col("fqn"), s,
                      inserts=F.col("n_tup_ins").cast("bigint"), updates=F.col("n_tup_upd").cast("bigint"),
                      deletes=F.col("n_tup_del").cast("bigint"))
    return out.filter(F.col("severity").isNotNull())


@register_check("deferrable_constraints", "schema", needs=("cat_class", "cat_namespace", "cat_constraint"),
                description="Deferrable PRIMARY KEY / UNIQUE constraints",
                title=lambda: F.format_string("%s %s is checked late", F.col("constraint_type"), F.col("object_name")),
                remediation=lambda: F.lit("Make the constraint NOT DEFERRABLE; conflict detection "
                                          "uses immediate unique checks."),
                offline=True)
def deferrable_constraints(cat):
    con = cat["cat_constraint"].filter(F.col("contype").isin("p", "u") & F.col("condeferrable"))
    t = con.join(cat.user_classes().withColumnRenamed("oid", "conrelid"), cat.keys + ["conrelid"])
    return facts_frame(t, cat.keys, qualify("fqn", "conname"),
                       F.when(F.col("contype") == "p", F.lit(CRITICAL)).otherwise(F.lit(WARNING)),
                       constraint_type=code_labels("contype", CONSTRAINT_TYPE_LABELS),
                       initially=F.when(F.col("condeferred"), F.lit("DEFERRED")).otherwise(F.lit("IMMEDIATE")))


@register_check("exclusion_constraints", "schema", needs=("cat_class", "cat_namespace", "cat_constraint"),
                description="Exclusion constraints cannot be enforced across nodes",
                title=lambda: F.format_string("%s: rows exclude each other", F.col("object_name")),
                remediation=lambda: F.lit("Replace with application-level checks or keep the "
                                          "constrained writes on one node."),
                offline=True)
def exclusion_constraints(cat):
    con = cat["cat_constraint"].filter(F.col("contype") == "x")
    t = con.join(cat.user_classes().withColumnRenamed("oid", "conrelid"), cat.keys + ["conrelid"])
    return facts_frame(t, cat.keys, qualify("fqn", "conname"), F.lit(WARNING), table_name=F.col("fqn"))


@register_check("foreign_keys", "schema", needs=("cat_class", "cat_namespace", "cat_constraint"),
                description="Foreign keys, CASCADE actions in particular",
                title=lambda: F.when(F.col("object_name") == "(database)", F.format_string(
                    "%d foreign keys in all", F.col("fk_count")))
                .otherwise(F.format_string("Foreign key %s passes changes on to %s", F.col("constraint_name"),
                                           F.col("object_name"))),
                remediation=lambda: F.when(F.col("object_name") == "(database)", F.lit(
                    "Make sure parent and child rows replicate in the same replication set."))
                .otherwise(F.lit("Review CASCADE actions: cascaded changes are applied on every node.")),
                offline=True)
def foreign_keys(cat):
    k = cat.keys
    fk = cat["cat_constraint"].filter(F.col("contype") == "f")
    child = cat.user_classes().select(*k, F.col("oid").alias("conrelid"), F.col("fqn"))
    ref = (cat["cat_class"].join(cat["cat_namespace"].select(*k, F.col("oid").alias("relnamespace"),
                                                             F.col("nspname").alias("rnsp")),
                                 k + ["relnamespace"])
           .select(*k, F.col("oid").alias("confrelid"), qualify("rnsp", "relname").alias("ref_table")))
    # a dump may reference tables it does not define: keep such keys offline
    how = "left" if getattr(cat, "source", "catalog") == "dump" else "inner"
    rows = (fk.join(child, k + ["conrelid"]).join(ref, k + ["confrelid"], how)
              .withColumn("is_cascade", (F.col("confdeltype") == "c") | (F.col("confupdtype") == "c")))
    totals = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("fk_count"),
                                  F.count_if("is_cascade").alias("cascade_count"))
    detail = facts_frame(rows.filter("is_cascade").join(totals, k), k, F.col("fqn"), F.lit(WARNING),
                         constraint_name=F.col("conname"), ref_table=F.col("ref_table"),
                         on_delete=code_labels("confdeltype", FK_ACTION_LABELS),
                         on_update=code_labels("confupdtype", FK_ACTION_LABELS),
                         fk_count=F.col("fk_count"), cascade_count=F.col("cascade_count"))
    summary = facts_frame(totals, k, F.lit("(database)"), F.lit(CONSIDER),
                          constraint_name=F.lit(None).cast("string"), ref_table=F.lit(None).cast("string"),
                          on_delete=F.lit(None).cast("string"), on_update=F.lit(None).cast("string"),
                          fk_count=F.col("fk_count"), cascade_count=F.col("cascade_count"))
    return detail.unionByName(summary)


@register_check("missing_fk_indexes", "schema",
                needs=("cat_class", "cat_namespace", "cat_constraint", "cat_index", "cat_attribute"),
                description="Foreign keys without an index on their columns",
                title=lambda: F.format_string("%s: no index leads with the referencing columns %s", F.col("object_name"),
                                              F.col("fk_columns")),
                remediation=lambda: F.format_string("CREATE INDEX ON %s (%s);", F.col("object_name"),
                                                    F.col("fk_columns")),
                offline=True)
def missing_fk_indexes(cat):
    k = cat.keys
    fk = cat["cat_constraint"].filter(F.col("contype") == "f").select(*k, "conrelid", "conname", "conkey")
    fk = fk.join(cat.user_classes().select(*k, F.col("oid").alias("conrelid"), "fqn"), k + ["conrelid"])
    uncovered = prefix_cover_anti(fk, cat["cat_index"], k + ["conrelid"], k + ["indrelid"], "conkey", "indkey")
    cols = (uncovered.select(*k, "conrelid", "conname", "fqn", F.posexplode("conkey").alias("pos", "attnum"))
            .join(cat["cat_attribute"].select(*k, F.col("attrelid").alias("conrelid"), "attnum", "attname"),
                  k + ["conrelid", "attnum"]))
    g = cols.groupBy(*k, "conrelid", "conname", "fqn").agg(
        F.array_join(ordered_array_agg("attname", "pos"), ",").alias("fk_columns"))
    # from a dump the finding is a CONSIDER (index coverage cannot be confirmed offline)
    sev = CONSIDER if getattr(cat, "source", "catalog") == "dump" else WARNING
    return facts_frame(g, k, F.col("fqn"), F.lit(sev), constraint_name=F.col("conname"),
                       fk_columns=F.col("fk_columns"))


@register_check("sequence_pks", "schema", needs=("cat_class", "cat_namespace", "cat_constraint", "cat_attribute"),
                description="Primary keys backed by a standard sequence or identity",
                title=lambda: F.format_string("%s.%s: keys are drawn from a sequence of one node",
                                              F.col("object_name"), F.col("column_name")),
                remediation=lambda: F.lit("Use globally unique keys (snowflake ids or per-node "
                                          "sequence ranges) before enabling multi-master writes."),
                offline=True)
def sequence_pks(cat):
    k = cat.keys
    pk = (cat["cat_constraint"].filter(F.col("contype") == "p")
          .select(*k, F.col("conrelid").alias("oid"), F.explode("conkey").alias("attnum")))
    t = cat.user_classes("r").join(pk, k + ["oid"])
    att = cat["cat_attribute"].select(*k, F.col("attrelid").alias("oid"), "attnum", "attname",
                                      "attidentity", "default_expr")
    t = t.join(att, k + ["oid", "attnum"]).filter(
        F.coalesce(F.lower("default_expr").contains("nextval("), F.lit(False)) | (F.col("attidentity") != ""))
    if getattr(cat, "source", "catalog") == "dump":   # offline: snowflake-backed defaults are fine
        t = t.filter(~F.coalesce(F.lower("default_expr").contains("snowflake"), F.lit(False)))
    return facts_frame(t, k, F.col("fqn"), F.lit(CRITICAL), column_name=F.col("attname"),
                       kind=F.when(F.col("attidentity") != "", F.lit("identity")).otherwise(F.lit("serial")))


@register_check("unlogged_tables", "schema", needs=("cat_class", "cat_namespace"),
                description="UNLOGGED tables are not written to WAL and do not replicate",
                title=lambda: F.format_string("%s: changes are not logged, so they cannot be replicated", F.col("object_name")),
                remediation=lambda: F.format_string("ALTER TABLE %s SET LOGGED;", F.col("object_name")),
                offline=True)
def unlogged_tables(cat):
    t = cat.user_classes("r").filter(F.col("relpersistence") == "u")
    return facts_frame(t, cat.keys, F.col("fqn"), F.lit(WARNING))


@register_check("large_objects", "schema", needs=("cat_class", "cat_namespace", "cat_attribute", "cat_largeobject"),
                description="Large objects and oid-typed columns (large objects do not replicate)",
                title=lambda: F.when(F.col("object_name") == "pg_largeobject", F.format_string(
                    "%d large objects are stored", F.col("lob_count")))
                .otherwise(F.format_string("%s: the column holds object ids, perhaps of large objects", F.col("object_name"))),
                remediation=lambda: F.lit("Move large objects to bytea columns or use the LOLOR extension."),
                offline=True)
def large_objects(cat):
    k = cat.keys
    lob = cat["cat_largeobject"].groupBy(*k).agg(F.count(F.lit(1)).alias("lob_count"))
    lob_rows = facts_frame(lob.filter(F.col("lob_count") > 0), k, F.lit("pg_largeobject"), F.lit(WARNING),
                           column_name=F.lit(None).cast("string"), lob_count=F.col("lob_count"))
    att = cat["cat_attribute"].filter((F.col("attnum") > 0) & (F.col("atttype") == "oid"))
    cols = att.join(cat.user_classes("r").withColumnRenamed("oid", "attrelid"), k + ["attrelid"])
    col_rows = facts_frame(cols, k, qualify("fqn", "attname"), F.lit(WARNING),
                           column_name=F.col("attname"), lob_count=F.lit(0).cast("bigint"))
    return lob_rows.unionByName(col_rows)


def _user_columns(cat):
    return cat["cat_attribute"].join(cat.user_classes("r").withColumnRenamed("oid", "attrelid"),
                                     cat.keys + ["attrelid"])


@register_check("column_defaults", "schema", needs=("cat_class", "cat_namespace", "cat_attribute"),
                description="Volatile column defaults (now(), random(), ...) may differ across nodes",
                title=lambda: F.format_string("%s: the default may differ on every node: %s", F.col("object_name"),
                                              F.col("default_expr")),
                remediation=lambda: F.lit("Set the value explicitly in the application, or accept "
                                          "that each node computes its own default."),
                offline=True)
def column_defaults(cat):
    t = _user_columns(cat).filter((F.col("attgenerated") == "") & F.col("default_expr").isNotNull())
    low = F.lower("default_expr")
    t = t.filter(~low.contains("nextval(") & keyword_any(low, VOLATILE_DEFAULT_PATTERNS))
    return facts_frame(t, cat.keys, qualify("fqn", "attname"), F.lit(CONSIDER),
                       column_name=F.col("attname"), default_expr=F.col("default_expr"))


@register_check("numeric_columns", "schema", needs=("cat_class", "cat_namespace", "cat_attribute"),
                description="Numeric counter-like columns that may be Delta-Apply candidates",
                title=lambda: F.when(F.col("severity") == WARNING, F.format_string(
                    "%s: adds up over nodes only if it is never null", F.col("object_name")))
                .otherwise(F.format_string("%s: a number (%s) that could be added up over nodes", F.col("object_name"),
                                           F.col("data_type"))),
                remediation=lambda: F.when(F.col("severity") == WARNING, F.format_string(
                    "If this column will use Delta-Apply: ALTER TABLE ... ALTER COLUMN %s SET NOT NULL;",
                    F.col("column_name"))).otherwise(F.lit("Configure Delta-Apply for this column if it "
                                                           "is an accumulator.")),
                offline=True)
def numeric_columns(cat):
    base_type = F.trim(F.regexp_replace(F.lower("atttype"), r"\(.*$", ""))
    t = _user_columns(cat).filter((F.col("attnum") > 0) & base_type.isin(*NUMERIC_TYPES))
    t = t.filter(keyword_any("attname", COUNTER_NAME_PATTERNS))
    return facts_frame(t, cat.keys, qualify("fqn", "attname"),
                       F.when(F.col("attnotnull"), F.lit(CONSIDER)).otherwise(F.lit(WARNING)),
                       column_name=F.col("attname"), data_type=F.col("atttype"))


@register_check("multiple_unique_indexes", "schema", needs=("cat_class", "cat_namespace", "cat_index"),
                description="Tables with more than one unique index (conflict resolution ambiguity)",
                title=lambda: F.format_string("%s: %d unique indexes may conflict", F.col("object_name"),
                                              F.col("unique_index_count")),
                remediation=lambda: F.lit("Make sure the replica identity index is the one conflicts "
                                          "should be resolved on."),
                offline=True)
def multiple_unique_indexes(cat):
    k = cat.keys
    ix = cat["cat_index"].filter("indisunique").withColumnRenamed("indrelid", "oid")
    t = ix.join(cat.user_classes("r"), k + ["oid"])
    g = t.groupBy(*k, "oid", "fqn").agg(F.count(F.lit(1)).alias("unique_index_count"),
                                        F.array_join(ordered_array_agg("indexname", "indexname"), ",")
                                        .alias("index_names"))
    return facts_frame(g.filter(F.col("unique_index_count") > 1), k, F.col("fqn"), F.lit(CONSIDER),
                       unique_index_count=F.col("unique_index_count"), index_names=F.col("index_names"))


@register_check("enum_types", "schema", needs=("cat_namespace", "cat_enum"),
                description="ENUM types: value changes are DDL that all nodes must apply",
                title=lambda: F.format_string("%s: an enumerated type with %d labels", F.col("object_name"),
                                              F.col("label_count")),
                remediation=lambda: F.lit("Apply ENUM changes through DDL replication on all nodes, "
                                          "or use a lookup table."),
                offline=True)
def enum_types(cat):
    k = cat.keys
    e = cat.with_namespace(cat["cat_enum"].withColumnRenamed("typnamespace", "relnamespace"), "typname")
    g = e.groupBy(*k, "nspname", "typname").agg(ordered_array_agg("enumlabel", "enumsortorder").alias("labels"))
    return facts_frame(g, k, qualify("nspname", "typname"), F.lit(CONSIDER),
                       label_count=F.size("labels").cast("bigint"), labels=F.array_join("labels", ","))


@register_check("generated_columns", "schema", needs=("cat_class", "cat_namespace", "cat_attribute"),
                description="Generated columns are recomputed on each node",
                title=lambda: F.format_string("%s: computed by the server (%s)", F.col("object_name"),
                                              F.col("gen_type")),
                remediation=lambda: F.lit("Make sure the generation expression gives the same result "
                                          "on every node."),
                offline=True)
def generated_columns(cat):
    t = _user_columns(cat).filter((F.col("attnum") > 0) & (F.col("attgenerated") != ""))
    return facts_frame(t, cat.keys, qualify("fqn", "attname"), F.lit(CONSIDER),
                       column_name=F.col("attname"), gen_type=code_labels("attgenerated", GENERATED_LABELS),
                       expression=F.col("default_expr"))


@register_check("rules", "schema", needs=("cat_class", "cat_namespace", "cat_rewrite"),
                description="Rewrite rules on tables",
                title=lambda: F.format_string("%s rule %s rewrites %s",
                                              F.when(F.col("is_instead"), F.lit("INSTEAD")).otherwise(F.lit("ALSO")),
                                              F.col("rule_name"), F.col("event")),
                remediation=lambda: F.lit("Replace rules with triggers or application logic; rules "
                                          "rewrite statements on each node."),
                offline=True)
def rules(cat):
    r = cat["cat_rewrite"].filter(F.col("rulename") != "_RETURN").withColumnRenamed("ev_class", "oid")
    t = r.join(cat.user_classes("r"), cat.keys + ["oid"])
    return facts_frame(t, cat.keys, qualify("fqn", "rulename"),
                       F.when(F.col("is_instead"), F.lit(WARNING)).otherwise(F.lit(CONSIDER)),
                       rule_name=F.col("rulename"), event=code_labels("ev_type", RULE_EVENT_LABELS),
                       is_instead=F.col("is_instead"))


@register_check("inheritance", "schema", needs=("cat_class", "cat_namespace", "cat_inherits"),
                description="Table inheritance (non-partition) is not replicated as a hierarchy",
                title=lambda: F.format_string("%s: child of %s", F.col("object_name"),
                                              F.col("parent_table")),
                remediation=lambda: F.lit("Add parent and child tables to replication sets "
                                          "explicitly, or convert to declarative partitioning."),
                offline=True)
def inheritance(cat):
    k = cat.keys
    cls = cat["cat_class"].filter(F.col("relkind") == "r")
    parent = (cat.with_namespace(cls, "oid")
              .select(*k, F.col("oid").alias("inhparent"), qualify("nspname", "relname").alias("parent_table")))
    ns_all = cat["cat_namespace"].select(*k, F.col("oid").alias("relnamespace"), "nspname")
    child = (cls.join(ns_all, k + ["relnamespace"])
             .select(*k, F.col("oid").alias("inhrelid"), qualify("nspname", "relname").alias("child_table")))
    t = cat["cat_inherits"].join(parent, k + ["inhparent"]).join(child, k + ["inhrelid"])
    return facts_frame(t, k, F.col("child_table"), F.lit(WARNING),
                       parent_table=F.col("parent_table"), child_table=F.col("child_table"))


@register_check("partitioned_tables", "schema", needs=("cat_class", "cat_namespace", "cat_partitioned", "cat_inherits"),
                description="Partitioned tables: partitions must match on every node",
                title=lambda: F.format_string("%s: partitioned by %s into %d", F.col("object_name"),
                                              F.col("strategy"), F.col("partition_count")),
                remediation=lambda: F.lit("Create the same partitions on every node before "
                                          "replicating, and add each partition to a replication set."))
def partitioned_tables(cat):
    k = cat.keys
    t = cat.user_classes("p").join(cat["cat_partitioned"].withColumnRenamed("partrelid", "oid"), k + ["oid"])
    t = correlated_count(t, cat["cat_inherits"], k + ["oid"], k + ["inhparent"], "partition_count")
    return facts_frame(t, k, F.col("fqn"), F.lit(CONSIDER),
                       strategy=code_labels("partstrat", PARTITION_STRATEGY_LABELS),
                       partition_count=F.col("partition_count"))


@register_check("row_level_security", "schema", needs=("cat_class", "cat_namespace", "cat_policy"),
                description="Row-level security: the apply worker bypasses policies",
                title=lambda: F.format_string("%s: rows are guarded by %d policies", F.col("object_name"),
                                              F.col("policy_count")),
                remediation=lambda: F.lit("Make sure policies are identical on all nodes; replicated "
                                          "changes are applied regardless of policies."))
def row_level_security(cat):
    k = cat.keys
    t = cat.user_classes("r").filter(F.col("relrowsecurity"))
    t = correlated_count(t, cat["cat_policy"], k + ["oid"], k + ["polrelid"], "policy_count")
    return facts_frame(t, k, F.col("fqn"), F.lit(WARNING), rls_forced=F.col("relforcerowsecurity"),
                       policy_count=F.col("policy_count"))


@register_check("event_triggers", "schema", needs=("cat_event_trigger",),
                description="Event triggers and whether they fire during apply",
                title=lambda: F.format_string("Event trigger %s fires at %s (%s)", F.col("object_name"),
                                              F.col("event"),
                                              code_labels("enabled", EVENT_TRIGGER_ENABLED_LABELS)),
                remediation=lambda: F.when(F.col("enabled").isin("A", "R"), F.lit(
                    "Check that the trigger is safe to run when DDL is applied by replication.")))
def event_triggers(cat):
    t = cat["cat_event_trigger"].filter(F.col("evtenabled") != "D")
    return facts_frame(t, cat.keys, F.col("evtname"),
                       sev((F.col("evtenabled") == "A", CONSIDER), (F.col("evtenabled") == "R", WARNING),
                           otherwise=INFO),
                       event=F.col("evtevent"), enabled=F.col("evtenabled"))


def _user_procs(cat):
    p = cat["cat_proc"].withColumnRenamed("pronamespace", "relnamespace")
    return cat.with_namespace(p, "oid") \
            .withColumn("fqn", qualify("nspname", "proname"))


@register_check("notify_listen", "schema", needs=("cat_namespace", "cat_proc", "stat_statements"),
                description="LISTEN/NOTIFY is not replicated",
                title=lambda: F.when(F.col("source") == "function", F.format_string(
                    "%s: the function notifies listeners", F.col("object_name")))
                .otherwise(F.format_string("Statements notified listeners %d times", F.col("calls"))),
                remediation=lambda: F.when(F.col("source") == "function", F.lit(
                    "Notifications fire only on the node where the transaction commits; listeners "
                    "must connect to every node.")))
def notify_listen(cat):
    k = cat.keys
    f = _user_procs(cat).filter(F.col("prosrc").rlike(NOTIFY_REGEX))
    f_rows = facts_frame(f, k, F.col("fqn"), F.lit(WARNING), source=F.lit("function"),
                         query=F.lit(None).cast("string"), calls=F.lit(0).cast("bigint"))
    s = current_statements(cat).filter(F.col("query").rlike("(?s)" + NOTIFY_REGEX))
    s_rows = facts_frame(s, k, F.lit("(query)"), F.lit(CONSIDER), source=F.lit("statement"),
                         query=F.col("query"), calls=F.col("calls").cast("bigint"))
    return f_rows.unionByName(s_rows)


@register_check("tablespace_usage", "schema", needs=("cat_class", "cat_namespace", "cat_tablespace"),
                description="Objects in non-default tablespaces",
                title=lambda: F.format_string("Tablespace %s holds %d objects", F.col("object_name"),
                                              F.col("object_count")),
                remediation=lambda: F.format_string("Create tablespace '%s' on all nodes before "
                                                    "initializing replication.", F.col("object_name")))
def tablespace_usage(cat):
    k = cat.keys
    c = cat.user_classes("r", "i", "m").filter(F.col("reltablespace") != 0)
    t = c.join(cat["cat_tablespace"].select(*k, F.col("oid").alias("reltablespace"), "spcname"),
               k + ["reltablespace"])
    label = F.concat(F.col("fqn"), F.lit(" ("), code_labels("relkind", RELKIND_LABELS), F.lit(")"))
    g = t.groupBy(*k, "spcname").agg(ordered_array_agg(label, "nspname", "relname").alias("objects"))
    return facts_frame(g, k, F.col("spcname"), F.lit(CONSIDER),
                       object_count=F.size("objects").cast("bigint"), objects=F.array_join("objects", ","))


@register_check("temp_tables", "schema", needs=("cat_namespace", "cat_proc"),
                description="Functions creating temporary tables",
                title=lambda: F.format_string("%s: the function makes temporary tables", F.col("object_name")),
                remediation=lambda: F.lit("Temporary tables are node-local; make sure the function "
                                          "does not depend on replicated temp data."))
def temp_tables(cat):
    t = _user_procs(cat).filter(F.col("prokind").isin("f", "p") & F.col("prosrc").rlike(TEMP_TABLE_REGEX))
    return facts_frame(t, cat.keys, F.col("fqn"), F.lit(CONSIDER))
