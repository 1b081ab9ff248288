"""SparkSession construction and the shared checkpoint folder.

On a cluster the session comes from the platform; ``get_spark`` only fills in
settings that are unset, so a cluster's own ``spark.checkpoint.dir`` (a shared
folder) always wins.  A machine-local folder is used only for local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  AQE re-plans joins from
# runtime sizes (broadcast only when the measured side is small), coalesces
# small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.scheduler.mode": "FAIR",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "fleetlint", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = os.environ.get("FLEETLINT_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset in local mode.

    On a cluster a driver-local folder would be lost on the executors, so a
    missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="fleetlint-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_SAVED: list[str] = []           # bucketed tables of this application's scratch folder


def written(df, name: str, bucket_by: list[str] | None = None):
    """``df`` written once as Parquet to the shared checkpoint folder and read back: columns stay prunable,
    the lineage is cut, and a lost executor re-reads files instead of deriving them again.

    ``bucket_by``: dealt and sorted by these columns, as many buckets as shuffle partitions, so that joins and
    groupings by them need no exchange."""
    import uuid
    spark = df.sparkSession
    unique = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = scratch_dir(spark, f"tables/{spark.sparkContext.applicationId}/{unique}")
    if bucket_by:
        bucketed(df, unique, path, bucket_by, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _SAVED.append(unique)
        return spark.table(unique)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df, table: str, path: str, keys: list[str], buckets: int, partition_by: str | None = None) -> None:
    """Save ``df`` as a table of the session catalog with its files under ``path``, bucketed and sorted by ``keys``; one
    file for each bucket (and partition)."""
    from pyspark.sql import functions as F
    w = df.repartition(buckets, *[F.col(k) for k in keys]).write.format("parquet").mode("overwrite").option("path", path)
    w = w.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    (w.partitionBy(partition_by) if partition_by else w).saveAsTable(table)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has written with ``written``; results that read them must be saved before."""
    while _SAVED:
        spark.sql(f"drop table if exists {_SAVED.pop()}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, f"tables/{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
