"""Extension checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relops import ordered_array_agg
from .common import CONSIDER, INFO, WARNING, current_statements, facts_frame, per_instance_count
from .registry import register_check
from .settings import setting_value

# What replication means for an extension, by the kind of thing it adds.
NOTES = {
    "types": "Adds types or functions that rows depend on: install the same version on every node.",
    "index": "Adds index operators only; rows replicate as before.",
    "local": "Works on this node's own data or connections: set it up on every node.",
    "statistics": "Shows statistics of this node only.",
    "maintenance": "Changes partitions on its own: run its maintenance on one node and replicate the DDL, or on all nodes alike.",
    "large_objects": "Keeps references to large objects, which logical replication leaves out; LOLOR replicates them.",
    "other_replication": "Distributes or replicates data itself and does not work together with Spock.",
}
# The known extensions (in this order) and those that warrant a warning.
KNOWN_EXTENSIONS = {
    "postgis": "types", "pg_partman": "maintenance", "pgcrypto": "types", "pg_trgm": "index", "btree_gist": "index",
    "btree_gin": "index", "hstore": "types", "ltree": "types", "citext": "types", "lo": "large_objects",
    "pg_stat_statements": "statistics", "dblink": "local", "postgres_fdw": "local", "file_fdw": "local",
    "timescaledb": "other_replication", "citus": "other_replication",
}
OFFLINE_EXTENSIONS = {"pgstattuple": "statistics"}
WARN_EXTENSIONS = ["timescaledb", "citus", "lo"]
LOLOR_MAX_NODE = 1 << 28


def known_extensions_table(spark, offline: bool = False):
    known = KNOWN_EXTENSIONS | (OFFLINE_EXTENSIONS if offline else {})
    rows = [(n, NOTES[kind], n in WARN_EXTENSIONS) for n, kind in known.items()]
    return spark.createDataFrame(rows, "extname string, note string, warn boolean")


def _installed(cat):
    return cat["cat_extension"].filter(F.col("installed"))


@register_check("installed_extensions", "extensions", needs=("cat_extension", "instances"),
                description="Installed extensions and their replication notes",
                title=lambda: F.when(F.col("object_name") == "(extensions)", F.format_string(
                    "%d extensions are installed", F.col("extension_count")))
                .when(F.col("version").isNull(), F.format_string("Extension %s", F.col("object_name")))
                .otherwise(F.format_string("Extension %s, version %s", F.col("object_name"), F.col("version"))),
                remediation=lambda: F.when(F.col("severity") == WARNING, F.col("note")),
                offline=True)
def installed_extensions(cat):
    k = cat.keys
    inst = _installed(cat)
    counts = inst.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(ordered_array_agg(F.when(F.col("extversion").isNull(), F.col("extname")).otherwise(
            F.format_string("%s (%s)", F.col("extname"), F.col("extversion"))), "extname"), ", ").alias("ext_list"))
    per_inst = cat.instances().select(*k).join(counts, k, "left").select(
        *k, F.coalesce("n", F.lit(0)).cast("bigint").alias("extension_count"),
        F.coalesce("ext_list", F.lit("")).alias("extensions"))
    offline = getattr(cat, "source", "catalog") == "dump"       # dumps may spell names in capitals
    names = known_extensions_table(cat.spark, offline).withColumnRenamed("extname", "known_name")
    same = F.col("known_name") == (F.lower("extname") if offline else F.col("extname"))
    known = inst.join(F.broadcast(names), same).join(per_inst, k)
    detail = facts_frame(known, k, F.col("extname"), F.when(F.col("warn"), F.lit(WARNING)).otherwise(F.lit(INFO)),
                         version=F.col("extversion"), note=F.col("note"),
                         extension_count=F.col("extension_count"), extensions=F.lit(None).cast("string"))
    summary = facts_frame(per_inst, k, F.lit("(extensions)"), F.lit(CONSIDER),
                          version=F.lit(None).cast("string"), note=F.lit(None).cast("string"),
                          extension_count=F.col("extension_count"), extensions=F.col("extensions"))
    if offline:   # summary only when any extension
        summary = summary.filter(F.col("extension_count") > 0)
    return detail.unionByName(summary)


@register_check("extension_versions", "extensions", needs=("cat_extension",),
                description="Installed extensions that are older than the available version",
                title=lambda: F.format_string("Extension %s has version %s, and %s is there", F.col("object_name"),
                                              F.col("installed_version"), F.col("available_version")),
                remediation=lambda: F.format_string("ALTER EXTENSION %s UPDATE; (on all nodes)",
                                                    F.col("object_name")))
def extension_versions(cat):
    t = _installed(cat).filter(F.col("extversion") != F.col("default_version"))
    return facts_frame(t, cat.keys, F.col("extname"), F.lit(CONSIDER),
                       installed_version=F.col("extversion"), available_version=F.col("default_version"))


@register_check("snowflake_ext", "extensions", needs=("cat_extension", "instances"),
                description="Snowflake extension for globally unique sequences",
                title=lambda: F.when(F.col("status") == "installed", F.format_string(
                    "Snowflake keys are ready (version %s)", F.col("version")))
                .when(F.col("status") == "available", F.format_string(
                    "Snowflake keys could be installed (version %s)", F.col("version")))
                .otherwise(F.lit("Snowflake keys cannot be installed")),
                remediation=lambda: F.when(F.col("status") == "available", F.lit(
                    "CREATE EXTENSION snowflake; and convert sequences with snowflake.convert_sequence_to_snowflake()."))
                .when(F.col("status") == "unavailable", F.lit(
                    "Install the snowflake extension package to get globally unique sequence values.")))
def snowflake_ext(cat):
    k = cat.keys
    sf = cat["cat_extension"].filter(F.col("extname") == "snowflake").groupBy(*k).agg(
        F.max(F.when(F.col("installed"), F.col("extversion"))).alias("iv"),
        F.max("default_version").alias("av"))
    t = cat.instances().select(*k).join(sf, k, "left")
    status = (F.when(F.col("iv").isNotNull(), F.lit("installed"))
               .when(F.col("av").isNotNull(), F.lit("available")).otherwise(F.lit("unavailable")))
    t = t.withColumn("status", status)
    return facts_frame(t, k, F.lit("snowflake"),
                       F.when(F.col("status") == "available", F.lit(CONSIDER)).otherwise(F.lit(INFO)),
                       status=F.col("status"), version=F.coalesce("iv", "av"))


@register_check("pg_stat_statements_check", "extensions", needs=("cat_extension", "instances"),
                description="Statement statistics extension presence",
                title=lambda: F.when(F.col("status") == "missing", F.lit("No statement statistics are kept"))
                .when(F.col("status") == "unreadable", F.lit("Statement statistics are kept but were not read"))
                .otherwise(F.format_string("Statement statistics hold %d statements",
                                           F.col("statement_count"))),
                remediation=lambda: F.when(F.col("status") == "missing", F.lit(
                    "CREATE EXTENSION pg_stat_statements; (with shared_preload_libraries) to enable SQL pattern checks."))
                .when(F.col("status") == "unreadable", F.lit("Grant pg_read_all_stats to the scanning role.")))
def pg_stat_statements_check(cat):
    k = cat.keys
    ext = _installed(cat).filter(F.col("extname") == "pg_stat_statements").select(*k, F.col("extversion").alias("version"))
    t = cat.instances().select(*k).join(ext, k, "left")
    if cat.has("stat_statements"):
        # an instance whose statistics could be read has rows in some snapshot
        counts = per_instance_count(cat, current_statements(cat), "statement_count")
        read = cat["stat_statements"].select(*k).distinct().withColumn("__read", F.lit(True))
        t = t.join(counts, k, "left").join(read, k, "left").withColumn("readable", F.coalesce("__read", F.lit(False)))
    else:
        t = t.withColumn("statement_count", F.lit(0).cast("bigint")).withColumn("readable", F.lit(False))
    status = (F.when(F.col("version").isNull(), F.lit("missing"))
               .when(~F.col("readable"), F.lit("unreadable")).otherwise(F.lit("present")))
    t = t.withColumn("status", status)
    return facts_frame(t, k, F.lit("pg_stat_statements"),
                       F.when(F.col("status") == "missing", F.lit(CONSIDER))
                        .when(F.col("status") == "unreadable", F.lit(WARNING)).otherwise(F.lit(INFO)),
                       status=F.col("status"),
                       statement_count=F.when(F.col("status") == "present", F.col("statement_count"))
                       .otherwise(F.lit(0)).cast("bigint"))


@register_check("lolor_check", "extensions",
                needs=("cat_extension", "cat_largeobject", "cat_attribute", "cat_class", "cat_namespace",
                       "settings", "instances"),
                description="Large objects need the LOLOR extension to replicate",
                title=lambda: F.when(F.col("status") == "not_installed", F.lit(
                    "Large objects are stored, and LOLOR is not installed to replicate them"))
                .when(F.col("status") == "node_unset", F.lit("LOLOR has no node number"))
                .when(F.col("status") == "node_invalid", F.format_string("LOLOR node number %s is out of range",
                                                                         F.col("node")))
                .otherwise(F.format_string("LOLOR runs as node %s", F.col("node"))),
                remediation=lambda: F.when(F.col("status") == "not_installed", F.lit(
                    "CREATE EXTENSION lolor; and add its tables to the default replication set."))
                .when(F.col("status").isin("node_unset", "node_invalid"), F.lit(
                    "Set lolor.node to a unique value between 1 and 2^28 on each node.")))
def lolor_check(cat):
    k = cat.keys
    lob = per_instance_count(cat, cat["cat_largeobject"], "lob_count")
    oid_cols = (cat["cat_attribute"].filter((F.col("attnum") > 0) & (F.col("atttype") == "oid"))
                .join(cat.user_classes("r").withColumnRenamed("oid", "attrelid"), k + ["attrelid"]))
    oidc = per_instance_count(cat, oid_cols, "oid_col_count")
    lol = _installed(cat).filter(F.col("extname") == "lolor").select(*k, F.col("extversion").alias("lolor_version"))
    node = setting_value(cat, "lolor.node", "node")
    t = lob.join(oidc, k).filter((F.col("lob_count") > 0) | (F.col("oid_col_count") > 0))
    t = t.join(lol, k, "left").join(node, k, "left")
    node_num = F.col("node").try_cast("bigint")
    status = (F.when(F.col("lolor_version").isNull(), F.lit("not_installed"))
               .when(F.col("node").isNull() | F.col("node").isin("", "0"), F.lit("node_unset"))
               .when(node_num.isNull() | (node_num < 1) | (node_num > LOLOR_MAX_NODE), F.lit("node_invalid"))
               .otherwise(F.lit("ok")))
    t = t.withColumn("status", status)
    return facts_frame(t, k, F.when(F.col("status").isin("node_unset", "node_invalid"), F.lit("lolor.node"))
                       .otherwise(F.lit("lolor")),
                       F.when(F.col("status") == "ok", F.lit(INFO)).otherwise(F.lit(WARNING)),
                       status=F.col("status"), lob_count=F.col("lob_count"), oid_col_count=F.col("oid_col_count"),
                       node=F.col("node"))
