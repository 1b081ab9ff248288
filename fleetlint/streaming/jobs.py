"""Structured Streaming variants of the activity jobs.

* ``stream_log_classes``: log files arriving in a folder; header lines with
  a statement are classified; counts per instance, class and event-time
  window.  Late lines beyond the watermark are dropped (Spark reports them
  in ``StreamingQueryProgress``).
* ``stream_stmt_delta``: statement-counter snapshots arriving as files; per
  (instance, statement key) the last counters are kept as state and every
  arrival emits its increase.  A counter drop is a reset (the new value is
  the delta).  A snapshot not newer than the key's last one is reported as
  ``late`` with no increase.  Idle keys expire by a timer in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The pandas functions of this module run in Python workers: ship them by
# value so executors need not have the package installed.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from ..plans.activity import log_line, logged_statement, statement_classes, stmt_key

STMT_SCHEMA = ("snapshot_no int, instance_id bigint, queryid bigint, query string, calls bigint, "
               "row_count bigint, total_exec_time double, snapshot_ts timestamp")
DELTA_SCHEMA = ("instance_id bigint, stmt_key string, snapshot_no int, query string, status string, "
                "delta_calls bigint, delta_time double, delta_rows bigint")
STATE_SCHEMA = "snapshot_no int, calls bigint, total_time double, row_count bigint, due bigint"


def log_classes_of(lines: DataFrame) -> DataFrame:
    """Single-line entries: header lines with their statement, event time and classes."""
    l = lines.withColumn("head", log_line("line")).filter(F.col("head").isNotNull() & (F.col("head.message") != ""))
    ts = F.to_timestamp(F.substring("head.ts", 1, 19))
    return l.select("instance_id", ts.alias("ts"), F.explode(statement_classes(logged_statement(F.col("head.message"))["text"])).alias("class"))


def stream_log_classes(spark: SparkSession, log_dir: str, watermark: str = "1 hour",
                       window: str = "1 hour") -> DataFrame:
    """Streaming counts per (instance, class, window) from text files under
    ``log_dir/instance_id=<n>/``."""
    raw = (spark.readStream.format("text").option("basePath", log_dir)
           .load(log_dir).withColumnRenamed("value", "line"))
    c = log_classes_of(raw.withColumn("instance_id", F.col("instance_id").cast("bigint")))
    return (c.withWatermark("ts", watermark)
             .groupBy("instance_id", "class", F.window("ts", window).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select("instance_id", "class", F.col("w.start").alias("window_start"),
                     F.col("w.end").alias("window_end"), "n"))


def batch_log_classes(lines: DataFrame, window: str = "1 hour") -> DataFrame:
    """The same counts as a batch job (for parity checks)."""
    c = log_classes_of(lines)
    return (c.groupBy("instance_id", "class", F.window("ts", window).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select("instance_id", "class", F.col("w.start").alias("window_start"),
                     F.col("w.end").alias("window_end"), "n"))


DELTA_COLUMNS = ["instance_id", "stmt_key", "snapshot_no", "query", "status", "delta_calls", "delta_time", "delta_rows"]
STATE_TTL_MS = 7 * 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's arrivals of a micro-batch, all chunks together: counters summed per snapshot, oldest first."""
    p = pd.concat(list(pdfs), ignore_index=True)
    return p.groupby("snapshot_no", as_index=False, sort=True).agg(
        query=("query", "min"), calls=("calls", "sum"), total_exec_time=("total_exec_time", "sum"), row_count=("row_count", "sum"), seen=("seen", "max"))


def deltas(key: tuple, rows: pd.DataFrame, prev: tuple | None):
    """(output rows, last counters) of one key's new snapshots after the counters ``prev`` (snapshot_no, calls, time, rows)."""
    out = []
    for r in rows.itertuples(index=False):
        new = (int(r.snapshot_no), int(r.calls), float(r.total_exec_time), int(r.row_count))
        if prev is not None and new[0] <= prev[0]:
            out.append((*key, new[0], r.query, "late", 0, 0.0, 0))
            continue
        if prev is None or new[1] < prev[1]:
            out.append((*key, new[0], r.query, "new" if prev is None else "reset", *new[1:]))
        elif new[1] > prev[1]:
            out.append((*key, new[0], r.query, "changed", *(n - p for n, p in zip(new[1:], prev[1:]))))
        prev = new
    return out, prev


class DeltaProcessor(StatefulProcessor):
    """Last counters of every (instance, statement) as a value state.

    ``ttl_ms`` after the event time of a key's last snapshot a timer clears the key, when the
    watermark passes it; a later arrival counts as new."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have = self.last.get() if self.last.exists() else None
        arrived = snapshot_rows(rows)
        out, prev = deltas(key, arrived, have[:4] if have else None)
        due = have[4] if have else None
        if self.ttl_ms is not None:
            seen = max(int(arrived["seen"].max()), (due - self.ttl_ms) if due else 0)
            if due is not None:
                self.handle.deleteTimer(due)
            due = seen + self.ttl_ms
            self.handle.registerTimer(due)
        self.last.update((*prev, due))
        if out:
            yield pd.DataFrame(out, columns=DELTA_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_stmt_delta(spark: SparkSession, snapshot_dir: str, ttl_ms: int | None = STATE_TTL_MS, watermark: str = "1 hour") -> DataFrame:
    """Streaming statement deltas from parquet snapshot files under ``snapshot_dir``.

    Null counters count as 0.  ``ttl_ms``: keys without a snapshot for that long, in event time
    (``snapshot_ts``, behind the watermark), expire; None keeps all keys and needs no event times.
    The state API needs the RocksDB state store; it is set where the session has Spark's default."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, ROCKSDB)
    s = spark.readStream.schema(STMT_SCHEMA).parquet(snapshot_dir)
    if ttl_ms is not None:
        s = s.withWatermark("snapshot_ts", watermark)
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in (("calls", "bigint"), ("row_count", "bigint"), ("total_exec_time", "double"))}
    seen = F.coalesce(F.unix_millis("snapshot_ts"), F.lit(0)).alias("seen")
    keep = ["snapshot_ts"] if ttl_ms is not None else []
    s = s.withColumns(zero).select("instance_id", stmt_key().alias("stmt_key"), "snapshot_no", "query", "calls", "row_count", "total_exec_time", seen, *keep)
    return s.groupBy("instance_id", "stmt_key").transformWithStateInPandas(
        DeltaProcessor(ttl_ms), DELTA_SCHEMA, "Append", "None" if ttl_ms is None else "EventTime")
