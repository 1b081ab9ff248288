"""Function, trigger and view checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import qualify
from ..operators.relops import code_labels, keyword_all_hits
from .common import CONSIDER, INFO, WARNING, facts_frame
from .registry import register_check
from .rules import keywords

# Fixed values
AUDITED_LANGUAGES = ["plpgsql", "sql", "plpython3u", "plperl", "plv8"]
PROKIND_LABELS = {"f": "function", "p": "procedure", "a": "aggregate", "w": "window"}
VOLATILITY_LABELS = {"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}
WRITE_PATTERNS = ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "CREATE ", "ALTER ", "DROP ", "EXECUTE ", "PERFORM "]
TRIGGER_ENABLED_LABELS = {"O": "ORIGIN (fires on non-replica sessions)", "D": "DISABLED",
                          "R": "REPLICA (fires during replica apply)", "A": "ALWAYS (fires in all sessions)"}
# trigger type bits: BEFORE 2, INSTEAD OF 64; events INSERT 4, DELETE 8, UPDATE 16, TRUNCATE 32
TRIGGER_EVENT_BITS = [("INSERT", 4), ("DELETE", 8), ("UPDATE", 16), ("TRUNCATE", 32)]


@register_check("stored_procedures", "functions", needs=("cat_namespace", "cat_proc"),
                description="Functions and procedures that write data or run DDL",
                title=lambda: F.when(F.col("object_name") == "(functions)", F.format_string(
                    "%d functions and procedures of users", F.col("total_count")))
                .otherwise(F.format_string("%s %s (%s, %s) writes",
                                           F.initcap("kind"), F.col("object_name"), F.col("language"),
                                           F.col("volatility"))),
                remediation=lambda: F.when(F.col("object_name") != "(functions)", F.lit(
                    "Writes inside functions replicate as row changes; DDL inside them needs DDL replication.")))
def stored_procedures(cat):
    k = cat.keys
    p = (cat.with_namespace(cat["cat_proc"].withColumnRenamed("pronamespace", "relnamespace"), "oid")
         .filter(F.col("lanname").isin(*AUDITED_LANGUAGES)))
    totals = p.groupBy(*k).agg(F.count(F.lit(1)).alias("total_count"))
    # body scan (prosrc); the full definition text would always contain "CREATE "
    w = p.withColumn("writes", keyword_all_hits("prosrc", keywords(cat, "function_writes", WRITE_PATTERNS))).filter(F.size("writes") > 0)
    detail = facts_frame(w.join(totals, k), k, qualify("nspname", "proname"), F.lit(CONSIDER),
                         kind=code_labels("prokind", PROKIND_LABELS), language=F.col("lanname"),
                         volatility=code_labels("provolatile", VOLATILITY_LABELS),
                         writes=F.array_join(F.transform("writes", lambda x: F.trim(x)), ","),
                         total_count=F.col("total_count"))
    nulls = {c: F.lit(None).cast("string") for c in ("kind", "language", "volatility", "writes")}
    summary = facts_frame(totals, k, F.lit("(functions)"), F.lit(INFO), **nulls, total_count=F.col("total_count"))
    return detail.unionByName(summary)


@register_check("trigger_functions", "functions",
                needs=("cat_trigger", "cat_class", "cat_namespace", "cat_proc"),
                description="Triggers: ENABLE REPLICA and ENABLE ALWAYS fire during apply",
                title=lambda: F.format_string("Trigger %s: %s %s, %s", F.col("object_name"), F.col("timing"),
                                              F.col("event"), code_labels("enabled", TRIGGER_ENABLED_LABELS)),
                remediation=lambda: F.when(F.col("enabled").isin("A", "R"), F.lit(
                    "Use ORIGIN mode (the default) unless the trigger must fire for replicated changes.")))
def trigger_functions(cat):
    k = cat.keys
    t = cat["cat_trigger"].filter(~F.col("tgisinternal"))
    rel = cat.user_classes().select(*k, F.col("oid").alias("tgrelid"), "fqn")
    ns_all = cat["cat_namespace"].select(*k, F.col("oid").alias("relnamespace"), "nspname")
    fn = (cat["cat_proc"].withColumnRenamed("pronamespace", "relnamespace").join(ns_all, k + ["relnamespace"])
          .select(*k, F.col("oid").alias("tgfoid"), qualify("nspname", "proname").alias("function")))
    t = t.join(rel, k + ["tgrelid"]).join(fn, k + ["tgfoid"])
    ty = F.col("tgtype")
    timing = (F.when((ty.bitwiseAND(66)) == 2, F.lit("BEFORE"))
               .when((ty.bitwiseAND(66)) == 64, F.lit("INSTEAD OF")).otherwise(F.lit("AFTER")))
    event = None
    for name, bit in TRIGGER_EVENT_BITS:
        cond = ty.bitwiseAND(bit) > 0
        event = F.when(cond, F.lit(name)) if event is None else event.when(cond, F.lit(name))
    event = event.otherwise(F.lit("UNKNOWN"))
    events = F.array_compact(F.array(*[F.when(ty.bitwiseAND(b) > 0, F.lit(n)) for n, b in TRIGGER_EVENT_BITS]))
    return facts_frame(t, k, qualify("fqn", "tgname"),
                       F.when(F.col("tgenabled").isin("A", "R"), F.lit(WARNING)).otherwise(F.lit(INFO)),
                       timing=timing, event=event, events=F.array_join(events, ","), function=F.col("function"),
                       enabled=F.col("tgenabled"))


@register_check("views_audit", "functions", mode="both", needs=("cat_class", "cat_namespace", "cat_trigger"),
                description="Materialized views and views with INSTEAD OF triggers",
                title=lambda: F.when(F.col("kind") == "materialized", F.format_string(
                    "%s: a stored view", F.col("object_name")))
                .when(F.col("kind") == "instead_of_trigger", F.format_string(
                    "%s: a view that trigger %s makes writable", F.col("object_name"), F.col("trigger_name")))
                .otherwise(F.format_string("%d views of users: %d stored, %d plain",
                                           F.col("view_count"), F.col("materialized_count"),
                                           F.col("view_count") - F.col("materialized_count"))),
                remediation=lambda: F.when(F.col("kind") == "materialized", F.lit(
                    "Schedule REFRESH MATERIALIZED VIEW on each node."))
                .when(F.col("kind") == "instead_of_trigger", F.lit(
                    "Review the INSTEAD OF trigger function for side effects.")))
def views_audit(cat):
    k = cat.keys
    views = cat.user_classes("v", "m")
    totals = views.groupBy(*k).agg(F.count(F.lit(1)).alias("view_count"),
                                   F.count_if(F.col("relkind") == "m").alias("materialized_count"))
    mat = facts_frame(views.filter(F.col("relkind") == "m").join(totals, k), k, F.col("fqn"), F.lit(CONSIDER),
                      kind=F.lit("materialized"), trigger_name=F.lit(None).cast("string"),
                      view_count=F.col("view_count"), materialized_count=F.col("materialized_count"))
    trg = cat["cat_trigger"].filter(F.col("tgtype").bitwiseAND(64) > 0).withColumnRenamed("tgrelid", "oid")
    tv = views.filter(F.col("relkind") == "v").join(trg, k + ["oid"]).join(totals, k)
    tv = facts_frame(tv, k, F.col("fqn"), F.lit(CONSIDER), kind=F.lit("instead_of_trigger"),
                     trigger_name=F.col("tgname"), view_count=F.col("view_count"),
                     materialized_count=F.col("materialized_count"))
    summary = facts_frame(totals, k, F.lit("(views)"), F.lit(INFO), kind=F.lit("total"),
                          trigger_name=F.lit(None).cast("string"), view_count=F.col("view_count"),
                          materialized_count=F.col("materialized_count"))
    return mat.unionByName(tv).unionByName(summary)
