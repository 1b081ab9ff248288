"""Pieces shared by several checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONSIDER, CRITICAL, INFO, WARNING  # noqa: F401  (re-export)


def facts_frame(df: DataFrame, keys: list[str], object_name: Column, severity: Column,
                **facts: Column) -> DataFrame:
    """Project to the facts shape: keys, object_name, severity, facts..."""
    return df.select(*[F.col(k).cast("bigint") if k == "instance_id" else F.col(k) for k in keys],
                     object_name.cast("string").alias("object_name"),
                     severity.alias("severity"),
                     *[c.alias(n) for n, c in facts.items()])


def current_statements(cat) -> DataFrame:
    """Statement counters of the newest snapshot of each instance."""
    def build() -> DataFrame:
        st = cat["stat_statements"]
        latest = st.groupBy(*cat.keys).agg(F.max("snapshot_no").alias("snapshot_no"))
        return st.join(latest, cat.keys + ["snapshot_no"], "left_semi")
    return cat.memo(("current_statements",), build)


def per_instance_count(cat, df: DataFrame, out: str) -> DataFrame:
    """Count rows per instance, zero for instances without rows (r_global_count)."""
    counts = df.groupBy(*cat.keys).agg(F.count(F.lit(1)).alias(out))
    return (cat.instances().select(*cat.keys).join(counts, cat.keys, "left")
               .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint")))


def sev(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    expr = None
    for cond, s in cases:
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def distinct_in_cluster(cat, rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with cluster_id and ``name``: the distinct ``value``s among the instances of the same cluster.

    Counted per snapshot (all scope keys but the instance), so an upgrade
    between two snapshots is no skew.  An instance without a cluster id, or
    missing from ``instances``, is a cluster of its own.
    """
    k = list(cat.keys)
    scope = [c for c in k if c != "instance_id"]
    own = F.coalesce(F.concat(F.lit("c"), F.col("cluster_id").cast("string")), F.concat(F.lit("i"), F.col("instance_id").cast("string")))
    t = rows.join(cat.instances().select(*k, "cluster_id"), k, "left").withColumn("cluster_key", own)
    n = t.groupBy(*scope, "cluster_key").agg(F.count_distinct(value).alias(name))
    return t.join(n, [*scope, "cluster_key"]).drop("cluster_key")
