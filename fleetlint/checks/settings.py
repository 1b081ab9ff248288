"""One fleet job for all single-setting rules (r_setting_rule).

``settings`` is joined once with the fixed rule table (broadcast: its size is
the number of rules below, independent of the data).  Each setting check of
the replication and config categories is a filter on this job's output, so
Catalyst prunes the rule table to that check before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relops import setting_rule_eval
from .common import CONSIDER, CRITICAL, WARNING
from .rules import setting_rules

# Fixed values: (check, setting, op, target, severity when violated).
#   eq  - value must equal target;  ne - value must differ from target;
#   min - integer value must be >= target.
SETTING_RULES = [
    ("wal_level", "wal_level", "eq", "logical", CRITICAL),
    ("track_commit_timestamp", "track_commit_timestamp", "eq", "on", CRITICAL),
    ("max_replication_slots", "max_replication_slots", "min", "10", WARNING),
    ("max_wal_senders", "max_wal_senders", "min", "10", WARNING),
    ("max_worker_processes", "max_worker_processes", "min", "16", WARNING),
    ("idle_transaction_timeout", "idle_in_transaction_session_timeout", "ne", "0", CONSIDER),
    ("idle_transaction_timeout", "idle_session_timeout", "ne", "0", CONSIDER),
    ("timezone_config", "timezone", "eq", "UTC", CONSIDER),
    ("timezone_config", "log_timezone", "eq", "UTC", CONSIDER),
    ("parallel_apply", "max_logical_replication_workers", "min", "4", WARNING),
    ("parallel_apply", "max_sync_workers_per_subscription", "min", "2", CONSIDER),
]


def rule_table(cat) -> DataFrame:
    """The fixed rules with the catalog's own (at most ``rules.RULE_ROWS`` rows)."""
    return cat.spark.createDataFrame(
        setting_rules(cat, SETTING_RULES), "check_name string, name string, op string, target string, fail_severity string")


def setting_evaluations(cat) -> DataFrame:
    """(keys, check_name, name, value, op, target, fail_severity, violated) per
    instance setting that has a rule."""
    def build() -> DataFrame:
        rules = F.broadcast(rule_table(cat))
        s = cat["settings"].select(*cat.keys, "name", F.col("setting").alias("value"))
        j = s.join(rules, "name")
        return j.withColumn("violated", F.coalesce(
            setting_rule_eval(F.col("value"), F.col("op"), F.col("target")), F.lit(False)))
    return cat.memo(("setting_evaluations",), build)


def violations(cat, check: str) -> DataFrame:
    return setting_evaluations(cat).filter((F.col("check_name") == check) & F.col("violated"))


def setting_value(cat, name: str, alias: str) -> DataFrame:
    """One setting per instance as a column (left-joinable on the keys)."""
    return (cat["settings"].filter(F.col("name") == name)
            .select(*cat.keys, F.col("setting").alias(alias)))
