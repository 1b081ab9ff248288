"""Replication checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import fmt_time, lsn_diff_bytes
from ..operators.relops import distributed_rank, ordered_array_agg
from .common import CONSIDER, CRITICAL, INFO, WARNING, distinct_in_cluster, facts_frame, per_instance_count, sev
from .registry import register_check
from .settings import violations

# Fixed values
SLOT_CRITICAL_MB = 1024
SLOT_WARNING_MB = 100


def _setting_check(cat, check: str, **extra):
    v = violations(cat, check)
    for name, df in extra.items():
        v = v.join(df, cat.keys, "left")
    cols = {k: F.col(k) for k in extra_cols(extra, cat.keys)}
    return facts_frame(v, cat.keys, F.col("name"), F.col("fail_severity"),
                       current=F.col("value"), required=F.col("target"), **cols)


def extra_cols(extra, keys):
    out = []
    for df in extra.values():
        out += [c for c in df.columns if c not in keys]
    return out


@register_check("wal_level", "replication", needs=("settings",),
                description="wal_level must be 'logical' for logical replication",
                title=lambda: F.format_string("wal_level = %s carries no row changes; logical is needed", F.col("current")),
                remediation=lambda: F.lit("ALTER SYSTEM SET wal_level = 'logical'; then restart."))
def wal_level(cat):
    return _setting_check(cat, "wal_level")


@register_check("max_replication_slots", "replication", needs=("settings", "replication_slots"),
                description="Enough replication slots for all peers",
                title=lambda: F.format_string("max_replication_slots = %s, %d taken",
                                              F.col("current"), F.col("used_slots")),
                remediation=lambda: F.lit("ALTER SYSTEM SET max_replication_slots = 10; then restart."))
def max_replication_slots(cat):
    used = per_instance_count(cat, cat["replication_slots"], "used_slots")
    return _setting_check(cat, "max_replication_slots", used=used)


@register_check("max_wal_senders", "replication", needs=("settings", "replication_slots"),
                description="Enough WAL senders for all peers",
                title=lambda: F.format_string("max_wal_senders = %s is short of 10", F.col("current")),
                remediation=lambda: F.lit("ALTER SYSTEM SET max_wal_senders = 10; then restart."))
def max_wal_senders(cat):
    # one row a sender, where snapshots hold that view; else active replication slots stand for senders
    if cat.has("stat_replication"):
        active = per_instance_count(cat, cat["stat_replication"], "active_slots")
    else:
        active = per_instance_count(cat, cat["replication_slots"].filter("active"), "active_slots")
    return _setting_check(cat, "max_wal_senders", active=active)


@register_check("max_worker_processes", "replication", needs=("settings",),
                description="Enough background workers for apply",
                title=lambda: F.format_string("max_worker_processes = %s", F.col("current")),
                remediation=lambda: F.lit("ALTER SYSTEM SET max_worker_processes = 16; then restart."))
def max_worker_processes(cat):
    return _setting_check(cat, "max_worker_processes")


@register_check("database_encoding", "replication", needs=("cat_database", "instances"),
                description="Database encoding should be UTF8 and equal across a cluster",
                title=lambda: F.when(F.col("severity") == CONSIDER, F.format_string(
                    "Text is stored as %s instead of UTF-8", F.col("encoding")))
                .otherwise(F.format_string("Text is stored as %s", F.col("encoding"))),
                remediation=lambda: F.when(F.col("severity") == CONSIDER, F.lit(
                    "Use the same encoding on all nodes; UTF8 is recommended.")))
def database_encoding(cat):
    k = cat.keys
    t = distinct_in_cluster(cat, cat["cat_database"].filter(~F.col("datistemplate")), "encoding", "cluster_encodings")
    return facts_frame(t, k, F.col("datname"),
                       F.when(F.col("encoding") != "UTF8", F.lit(CONSIDER)).otherwise(F.lit(INFO)),
                       encoding=F.col("encoding"), cluster_id=F.col("cluster_id"),
                       cluster_encodings=F.col("cluster_encodings"))


@register_check("multiple_databases", "replication", needs=("cat_database",),
                description="More than one user database on an instance",
                title=lambda: F.format_string("%d databases on the instance: %s",
                                              F.col("database_count"), F.col("databases")),
                remediation=lambda: F.lit("Each database needs its own replication setup; "
                                          "consider one database per instance."))
def multiple_databases(cat):
    k = cat.keys
    db = cat["cat_database"].filter(~F.col("datistemplate") & (F.col("datname") != "postgres"))
    g = db.groupBy(*k).agg(F.count(F.lit(1)).alias("database_count"),
                           F.array_join(ordered_array_agg("datname", "datname"), ", ").alias("databases"))
    return facts_frame(g.filter(F.col("database_count") > 1), k, F.lit("(instance)"), F.lit(WARNING),
                       database_count=F.col("database_count"), databases=F.col("databases"))


@register_check("hba_config", "replication", needs=("hba_rules", "instances"),
                description="pg_hba.conf must allow replication connections",
                title=lambda: F.when(F.col("status") == "unreadable", F.lit("The host access rules cannot be read"))
                .when(F.col("status") == "missing", F.lit("No host may connect for replication"))
                .otherwise(F.format_string("%d host rules allow replication",
                                           F.col("replication_entries"))),
                remediation=lambda: F.when(F.col("status") == "missing", F.lit(
                    "Add 'host replication <user> <peer-address> scram-sha-256' lines for every peer."))
                .when(F.col("status") == "ok", F.lit("Check that every peer node is covered."))
                .otherwise(F.lit("Grant read access to pg_hba_file_rules.")))
def hba_config(cat):
    k = cat.keys
    agg = cat["hba_rules"].groupBy(*k).agg(
        F.count_if(F.array_contains("databases", "replication")).alias("replication_entries"),
        F.count(F.lit(1)).alias("rules"))
    t = cat.instances().select(*k).join(agg, k, "left")
    status = (F.when(F.col("rules").isNull(), F.lit("unreadable"))
               .when(F.col("replication_entries") == 0, F.lit("missing")).otherwise(F.lit("ok")))
    return facts_frame(t, k, F.lit("pg_hba.conf"),
                       F.when(F.col("rules").isNotNull() & (F.col("replication_entries") == 0), F.lit(WARNING))
                        .otherwise(F.lit(CONSIDER)),
                       status=status,
                       replication_entries=F.coalesce(F.col("replication_entries"), F.lit(0)).cast("bigint"))


def _spock_instances(cat):
    return (cat["cat_namespace"].filter(F.col("nspname") == "spock").select(*cat.keys).distinct())


@register_check("repset_membership", "replication", mode="audit",
                needs=("cat_class", "cat_namespace", "repset_table", "instances"),
                description="User tables that are in no replication set",
                title=lambda: F.when(F.col("object_name") == "spock", F.lit(
                    "Replication sets are unknown: schema spock is missing"))
                .otherwise(F.format_string("%s: in no replication set", F.col("object_name"))),
                remediation=lambda: F.when(F.col("object_name") != "spock", F.format_string(
                    "SELECT spock.repset_add_table('default', '%s');", F.col("object_name"))))
def repset_membership(cat):
    k = cat.keys
    spock = _spock_instances(cat)
    members = cat["repset_table"].select(*k, F.col("set_reloid").alias("oid"))
    t = (cat.user_classes("r").join(spock, k, "left_semi").join(members, k + ["oid"], "left_anti"))
    rows = facts_frame(t, k, F.col("fqn"), F.lit(WARNING))
    no_spock = facts_frame(cat.instances().join(spock, k, "left_anti"), k, F.lit("spock"), F.lit(INFO))
    return rows.unionByName(no_spock)


@register_check("subscription_health", "replication", mode="audit",
                needs=("subscriptions", "replication_slots", "cat_namespace", "instances"),
                description="Subscriptions disabled or with inactive slots",
                title=lambda: F.when(F.col("kind") == "disabled", F.format_string(
                    "Subscription %s is switched off", F.col("object_name")))
                .when(F.col("kind") == "slot_inactive", F.format_string(
                    "Nobody reads slot %s", F.col("object_name")))
                .when(F.col("kind") == "no_spock", F.lit("Subscriptions are unknown: schema spock is missing"))
                .otherwise(F.lit("There are no subscriptions")),
                remediation=lambda: F.when(F.col("kind") == "disabled", F.format_string(
                    "SELECT spock.alter_subscription_enable('%s');", F.col("object_name")))
                .when(F.col("kind") == "slot_inactive", F.lit("Check network connectivity and provider node status.")))
def subscription_health(cat):
    k = cat.keys
    spock = _spock_instances(cat)
    subs = cat["subscriptions"].join(spock, k, "left_semi")
    disabled = facts_frame(subs.filter(~F.col("sub_enabled")), k, F.col("sub_name"), F.lit(CRITICAL),
                           kind=F.lit("disabled"), subscription=F.col("sub_name"))
    slots = cat["replication_slots"].select(*k, F.col("slot_name").alias("sub_slot_name"), "active")
    inactive = subs.join(slots, k + ["sub_slot_name"]).filter(~F.col("active"))
    inactive = facts_frame(inactive, k, F.col("sub_slot_name"), F.lit(WARNING),
                           kind=F.lit("slot_inactive"), subscription=F.col("sub_name"))
    none = facts_frame(spock.join(subs.select(*k), k, "left_anti"), k, F.lit("spock.subscription"),
                       F.lit(INFO), kind=F.lit("none"), subscription=F.lit(None).cast("string"))
    no_spock = facts_frame(cat.instances().join(spock, k, "left_anti"), k, F.lit("spock"), F.lit(INFO),
                           kind=F.lit("no_spock"), subscription=F.lit(None).cast("string"))
    return disabled.unionByName(inactive).unionByName(none).unionByName(no_spock)


@register_check("stale_replication_slots", "replication", mode="audit", needs=("replication_slots",),
                description="Inactive replication slots retaining WAL",
                title=lambda: F.format_string("Slot %s is not read and holds back %.0f MB of log",
                                              F.col("object_name"), F.col("retained_mb")),
                remediation=lambda: F.format_string(
                    "Drop the slot if it is no longer needed: SELECT pg_drop_replication_slot('%s');",
                    F.col("object_name")))
def stale_replication_slots(cat):
    s = cat["replication_slots"].filter(~F.col("active"))
    mb = F.coalesce(lsn_diff_bytes("current_lsn", "restart_lsn").cast("double") / F.lit(1048576.0),
                    F.lit(0.0))
    s = s.withColumn("retained_mb", mb)
    return facts_frame(s, cat.keys, F.col("slot_name"),
                       sev((F.col("retained_mb") > SLOT_CRITICAL_MB, CRITICAL),
                           (F.col("retained_mb") > SLOT_WARNING_MB, WARNING), otherwise=CONSIDER),
                       slot_type=F.col("slot_type"), restart_lsn=F.col("restart_lsn"),
                       retained_mb=F.col("retained_mb"))


def _log_rollup(cat, table: str, group_cols: list, ts: str, count_name: str,
                total_sev_when_any: str, row_sev: str, object_col: str, summary_object: str, extra):
    """Shared shape of conflict_log / exception_log: every group with its
    count and rank (deterministic tie-break), total per instance, INFO when
    the instance has none.  Ranks are over pre-aggregated groups."""
    k = cat.keys
    src = cat[table]
    g = src.groupBy(*k, *group_cols).agg(F.count(F.lit(1)).alias(count_name),
                                         F.max(ts).alias("last_ts"))
    totals = g.groupBy(*k).agg(F.sum(count_name).cast("bigint").alias("total"))
    inst = cat.instances().select(*k).join(totals, k, "left") \
        .select(*k, F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    # groups of one instance may be nearly as many as its rows
    detail = distributed_rank(g, k, [F.col(count_name).desc(), *[F.col(c).asc() for c in group_cols]], "rank").join(inst, k)
    detail = facts_frame(detail, k, F.col(object_col), F.lit(row_sev), kind=F.lit("group"),
                         **extra, event_count=F.col(count_name), last_event=fmt_time("last_ts"),
                         rank=F.col("rank").cast("bigint"), total=F.col("total"))
    nulls = {n: F.lit(None).cast("string") for n in extra}
    summary = facts_frame(inst, k, F.lit(summary_object),
                          F.when(F.col("total") > 0, F.lit(total_sev_when_any)).otherwise(F.lit(INFO)),
                          kind=F.when(F.col("total") > 0, F.lit("total")).otherwise(F.lit("none")),
                          **nulls, event_count=F.col("total"), last_event=F.lit(None).cast("string"),
                          rank=F.lit(0).cast("bigint"), total=F.col("total"))
    return detail.unionByName(summary)


@register_check("conflict_log", "replication", mode="audit", needs=("conflict_history", "instances"),
                description="Replication conflicts recorded in the conflict history",
                title=lambda: F.when(F.col("kind") == "group", F.format_string(
                    "%d conflicts of kind %s on %s", F.col("event_count"), F.col("conflict_type"), F.col("object_name")))
                .when(F.col("kind") == "total", F.format_string("%d conflicts in all",
                                                                F.col("total")))
                .otherwise(F.lit("The conflict history is empty")))
def conflict_log(cat):
    return _log_rollup(cat, "conflict_history", ["table_name", "conflict_type", "resolution"], "conflict_ts",
                       "n", WARNING, WARNING, "table_name", "spock.conflict_history",
                       {"conflict_type": F.col("conflict_type"), "resolution": F.col("resolution")})


@register_check("exception_log", "replication", mode="audit", needs=("exception_log", "instances"),
                description="Apply exceptions recorded in the exception log",
                title=lambda: F.when(F.col("kind") == "group", F.format_string(
                    "%d changes of %s from origin %s could not be applied", F.col("event_count"), F.col("object_name"),
                    F.col("origin")))
                .when(F.col("kind") == "total", F.format_string("%d changes in all could not be applied",
                                                                F.col("total")))
                .otherwise(F.lit("The exception log is empty")),
                remediation=lambda: F.when(F.col("kind") == "group", F.lit(
                    "Review the failing rows and resolve the cause on the subscriber.")))
def exception_log(cat):
    return _log_rollup(cat, "exception_log", ["remote_origin", "table_name", "error_message"], "exception_time",
                       "n", CRITICAL, CRITICAL, "table_name", "spock.exception_log",
                       {"origin": F.col("remote_origin").cast("string"),
                        "error_message": F.col("error_message")})
