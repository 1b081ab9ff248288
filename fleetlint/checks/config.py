"""Config checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import trimmed_list
from .common import CONSIDER, CRITICAL, INFO, WARNING, distinct_in_cluster, facts_frame
from .registry import register_check
from .rules import setting_rules
from .settings import setting_value, violations

# Fixed values
SUPPORTED_MAJORS = [15, 16, 17, 18]
PARALLEL_APPLY_SETTINGS = ["max_worker_processes", "max_parallel_workers",
                           "max_logical_replication_workers", "max_sync_workers_per_subscription"]
# (setting, recommended value, severity when the value differs)
SPOCK_GUCS = [
    ("spock.conflict_resolution", "last_update_wins", WARNING),
    ("spock.save_resolutions", "on", INFO),
    ("spock.enable_ddl_replication", "on", WARNING),
    ("spock.include_ddl_repset", "on", INFO),
    ("spock.allow_ddl_from_functions", "on", INFO),
]


def _version_num(cat):
    return setting_value(cat, "server_version_num", "v").withColumn("version_num", F.col("v").try_cast("bigint"))


@register_check("pg_version", "config", needs=("settings",),
                description="PostgreSQL major version supported by the replication extension",
                title=lambda: F.when(F.col("severity") == WARNING, F.lit(
                    "Could not determine the PostgreSQL version of the dump"))
                .when(F.col("severity") == CRITICAL, F.format_string(
                    "Server version %d has no Spock 5 release", F.col("major")))
                .otherwise(F.format_string("Server version %d runs Spock 5", F.col("major"))),
                remediation=lambda: F.when(F.col("severity") == CRITICAL, F.lit(
                    "Upgrade to a supported major version (15, 16, 17 or 18).")).when(
                    F.col("severity") == WARNING, F.lit("Check that the dump header names the server version.")),
                offline=True)
def pg_version(cat):
    t = _version_num(cat).filter(F.col("version_num").isNotNull())
    t = t.withColumn("major", F.expr("version_num div 10000"))
    out = facts_frame(t, cat.keys, F.lit("pg_version"),
                      F.when(F.col("major").isin(*SUPPORTED_MAJORS), F.lit(INFO)).otherwise(F.lit(CRITICAL)),
                      major=F.col("major").cast("bigint"), version_num=F.col("version_num"))
    if getattr(cat, "source", "catalog") == "dump":
        # offline: a dump without a readable version header is a WARNING
        unknown = cat.instances().select(*cat.keys).join(t.select(*cat.keys), cat.keys, "left_anti")
        out = out.unionByName(facts_frame(unknown, cat.keys, F.lit("pg_version"), F.lit(WARNING),
                                          major=F.lit(0).cast("bigint"), version_num=F.lit(0).cast("bigint")))
    return out


@register_check("pg_minor_version", "config", mode="audit", needs=("settings", "instances"),
                description="PostgreSQL version; all nodes of a cluster should match",
                title=lambda: F.format_string("Server version %s", F.col("server_version")),
                remediation=lambda: F.lit("Run the same minor version on all nodes of a cluster."))
def pg_minor_version(cat):
    k = cat.keys
    t = _version_num(cat).filter(F.col("version_num").isNotNull()).withColumn(
        "server_version", F.format_string("%d.%d", F.expr("version_num div 10000"), F.col("version_num") % 10000))
    t = distinct_in_cluster(cat, t, "server_version", "cluster_versions")
    return facts_frame(t, k, F.lit("pg_version"), F.lit(CONSIDER), server_version=F.col("server_version"),
                       cluster_id=F.col("cluster_id"), cluster_versions=F.col("cluster_versions"))


@register_check("track_commit_timestamp", "config", needs=("settings",),
                description="track_commit_timestamp must be on for last-update-wins",
                title=lambda: F.format_string("track_commit_timestamp = %s keeps no commit times; on is needed", F.col("current")),
                remediation=lambda: F.lit("ALTER SYSTEM SET track_commit_timestamp = on; then restart."))
def track_commit_timestamp(cat):
    v = violations(cat, "track_commit_timestamp")
    return facts_frame(v, cat.keys, F.col("name"), F.col("fail_severity"), current=F.col("value"))


@register_check("parallel_apply", "config", needs=("settings", "instances"),
                description="Apply worker settings",
                title=lambda: F.when(F.col("object_name") == "(config)", F.lit("Workers for parallel apply"))
                .otherwise(F.format_string("%s = %s", F.col("object_name"), F.col("current"))),
                remediation=lambda: F.when(F.col("object_name") == "max_logical_replication_workers",
                                           F.lit("Raise max_logical_replication_workers to at least 4."))
                .when(F.col("object_name") == "max_sync_workers_per_subscription",
                      F.lit("Raise max_sync_workers_per_subscription to at least 2."))
                .otherwise(F.lit("Size worker settings for the number of subscriptions.")))
def parallel_apply(cat):
    k = cat.keys
    v = violations(cat, "parallel_apply")
    rows = facts_frame(v, k, F.col("name"), F.col("fail_severity"), current=F.col("value"),
                       **{n: F.lit(None).cast("string") for n in PARALLEL_APPLY_SETTINGS})
    s = cat["settings"].filter(F.col("name").isin(*PARALLEL_APPLY_SETTINGS))
    piv = s.groupBy(*k).pivot("name", PARALLEL_APPLY_SETTINGS).agg(F.max("setting"))
    summ = cat.instances().select(*k).join(piv, k, "left")
    summary = facts_frame(summ, k, F.lit("(config)"), F.lit(CONSIDER), current=F.lit(None).cast("string"),
                          **{n: F.col(n) for n in PARALLEL_APPLY_SETTINGS})
    return rows.unionByName(summary)


@register_check("shared_preload_libraries", "config", mode="audit", needs=("settings",),
                description="The replication library must be preloaded",
                title=lambda: F.lit("Library spock is not loaded at server start"),
                remediation=lambda: F.lit("Add spock to shared_preload_libraries and restart."))
def shared_preload_libraries(cat):
    t = setting_value(cat, "shared_preload_libraries", "libs").withColumn("lib_list", trimmed_list("libs"))
    t = t.filter(~F.array_contains("lib_list", "spock"))
    return facts_frame(t, cat.keys, F.lit("shared_preload_libraries"), F.lit(CRITICAL),
                       current_libs=F.array_join("lib_list", ","))


@register_check("spock_gucs", "config", mode="audit", needs=("settings", "instances"),
                description="Recommended replication extension settings",
                title=lambda: F.when(F.col("status") == "missing", F.format_string(
                    "Setting %s is unknown to the server", F.col("object_name")))
                .when(F.col("status") == "mismatch", F.format_string(
                    "%s = %s, better %s", F.col("object_name"), F.col("current"), F.col("recommended")))
                .otherwise(F.format_string("%s = %s is fine", F.col("object_name"), F.col("current"))),
                remediation=lambda: F.when(F.col("status") == "mismatch", F.format_string(
                    "ALTER SYSTEM SET %s = '%s';", F.col("object_name"), F.col("recommended"))))
def spock_gucs(cat):
    k = cat.keys
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("recommended"), F.lit(s).alias("rule_sev"))
                      for _, n, _, r, s in setting_rules(cat, [("spock_gucs", n, "eq", r, s) for n, r, s in SPOCK_GUCS], {"spock_gucs"})])
    grid = cat.instances().select(*k, F.inline(rules))
    t = grid.join(cat["settings"].select(*k, "name", F.col("setting").alias("current")), k + ["name"], "left")
    status = (F.when(F.col("current").isNull(), F.lit("missing"))
               .when(F.col("current") != F.col("recommended"), F.lit("mismatch")).otherwise(F.lit("ok")))
    t = t.withColumn("status", status)
    return facts_frame(t, k, F.col("name"),
                       F.when(F.col("status") == "mismatch", F.col("rule_sev")).otherwise(F.lit(INFO)),
                       current=F.col("current"), recommended=F.col("recommended"), status=F.col("status"))


@register_check("timezone_config", "config", needs=("settings",),
                description="Server and log time zone should be UTC",
                title=lambda: F.when(F.col("severity") == INFO, F.lit("Clock and log run in UTC"))
                .otherwise(F.format_string("%s = %s, better UTC", F.col("object_name"), F.col("current"))),
                remediation=lambda: F.when(F.col("severity") == CONSIDER, F.format_string(
                    "ALTER SYSTEM SET %s = 'UTC'; SELECT pg_reload_conf();", F.col("object_name"))))
def timezone_config(cat):
    k = cat.keys
    v = violations(cat, "timezone_config")
    rows = facts_frame(v, k, F.col("name"), F.col("fail_severity"), current=F.col("value"))
    s = cat["settings"].filter(F.col("name").isin("timezone", "log_timezone"))
    both = s.groupBy(*k).agg(F.count_if((F.col("name") == "timezone") & (F.col("setting") == "UTC")).alias("tz"),
                             F.count_if((F.col("name") == "log_timezone") & (F.col("setting") == "UTC")).alias("ltz"))
    ok = facts_frame(both.filter((F.col("tz") > 0) & (F.col("ltz") > 0)), k, F.lit("timezone"), F.lit(INFO),
                     current=F.lit("UTC"))
    return rows.unionByName(ok)


@register_check("idle_transaction_timeout", "config", needs=("settings",),
                description="Idle transaction and session timeouts",
                title=lambda: F.format_string("No limit is set by %s", F.col("object_name")),
                remediation=lambda: F.format_string(
                    "ALTER SYSTEM SET %s = '10min'; SELECT pg_reload_conf();", F.col("object_name")))
def idle_transaction_timeout(cat):
    v = violations(cat, "idle_transaction_timeout")
    return facts_frame(v, cat.keys, F.col("name"), F.col("fail_severity"), current=F.col("value"))
