"""Streaming = batch: windowed log classes and stateful statement deltas."""
import os
import tempfile

from pyspark.sql import functions as F

from fleetlint.plans import activity as A
from fleetlint.sources.catalog import Catalog
from fleetlint.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_stream_log_classes_equals_batch_on_closed_windows(spark):
    cat = Catalog.from_fixtures(spark, SF)
    root = tempfile.mkdtemp(prefix="fleetlint-stream-logs-")
    rows = cat["log_lines"].orderBy("instance_id", "file_id", "line_no").collect()
    by_inst: dict = {}
    for r in rows:
        by_inst.setdefault(r.instance_id, []).append(r.line)
    for inst, ls in by_inst.items():
        d = os.path.join(root, f"instance_id={inst}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "a.log"), "w") as fh:
            fh.write("\n".join(ls) + "\n")
    # a later line advances the watermark so the fixture's window closes
    with open(os.path.join(root, "instance_id=0", "b.log"), "w") as fh:
        fh.write("2026-01-27 18:00:00 UTC [9] LOG:  statement: ALTER TABLE t ADD c int\n")
    out = tempfile.mkdtemp(prefix="fleetlint-stream-out-")
    q = (S.stream_log_classes(spark, root).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", out + "/ckpt").option("path", out + "/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out + "/data")
    lines = spark.read.option("basePath", root).text(root).withColumnRenamed("value", "line")
    batch = S.batch_log_classes(lines.withColumn("instance_id", F.col("instance_id").cast("bigint")))
    closed = batch.filter(F.col("window_end") <= F.lit("2026-01-27 17:00:00").cast("timestamp"))
    assert got.count() > 0
    assert sorted(map(tuple, got.select(*closed.columns).collect())) == sorted(map(tuple, closed.collect()))


def test_stream_stmt_delta_matches_batch_and_survives_restart(spark):
    cat = Catalog.from_fixtures(spark, SF)
    st = cat["stat_statements"].select("snapshot_no", F.col("instance_id").cast("bigint"), "queryid", "query",
                                       "calls", "row_count", F.col("total_exec_time").cast("double"))
    src = tempfile.mkdtemp(prefix="fleetlint-stream-stats-")
    out = tempfile.mkdtemp(prefix="fleetlint-stream-delta-")

    def run():
        q = (S.stream_stmt_delta(spark, src, ttl_ms=None).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", out + "/ckpt").option("path", out + "/data")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    st.filter("snapshot_no = 1").write.mode("append").parquet(src)
    run()
    first = spark.read.parquet(out + "/data").count()
    assert first == st.filter("snapshot_no = 1").count()
    st.filter("snapshot_no = 2").write.mode("append").parquet(src)
    run()   # restarts from the checkpoint: state holds the snapshot-1 counters
    d = spark.read.parquet(out + "/data").filter("snapshot_no = 2")
    got = sorted((r.instance_id, r.stmt_key, r.status, r.delta_calls) for r in d.collect())
    b = A.stmt_delta(cat["stat_statements"], ["instance_id"])
    want = sorted((r.instance_id, r.stmt_key, r.status, r.delta_calls) for r in b.collect())
    assert got == want


def test_late_lines_are_dropped_and_counted(spark):
    root = tempfile.mkdtemp(prefix="fleetlint-stream-late-")
    d = os.path.join(root, "instance_id=0")
    os.makedirs(d)
    with open(os.path.join(d, "a.log"), "w") as fh:
        fh.write("2026-01-27 10:00:00 UTC [1] LOG:  statement: ALTER TABLE t ADD c int\n"
                 "2026-01-27 15:00:00 UTC [1] LOG:  statement: ALTER TABLE t ADD d int\n")
    out = tempfile.mkdtemp(prefix="fleetlint-stream-late-out-")

    def run():
        q = (S.stream_log_classes(spark, root).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", out + "/ckpt").option("path", out + "/data")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    run()
    with open(os.path.join(d, "b.log"), "w") as fh:   # hours behind the watermark (14:00)
        fh.write("2026-01-27 09:00:00 UTC [1] LOG:  statement: DROP TABLE x\n")
    q = run()
    dropped = sum(op.get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped >= 1
    got = spark.read.parquet(out + "/data")
    assert got.filter(F.hour("window_start") == 9).count() == 0


def test_delta_of_split_chunks_and_late_snapshots():
    import pandas as pd

    def chunk(*rows):
        return pd.DataFrame([(*r, 0) for r in rows], columns=["snapshot_no", "query", "calls", "total_exec_time", "row_count", "seen"])

    # one key over two chunks, newest first; two rows of one snapshot add up
    out, last = S.deltas((0, "k"), S.snapshot_rows(iter([chunk((2, "q", 9, 9.5, 9)), chunk((1, "q", 3, 1.0, 3), (1, "q", 2, 1.5, 1))])), None)
    assert [r[2:3] + r[4:] for r in out] == [(1, "new", 5, 2.5, 4), (2, "changed", 4, 7.0, 5)] and last == (2, 9, 9.5, 9)
    out, last = S.deltas((0, "k"), S.snapshot_rows(iter([chunk((1, "q", 50, 1.0, 1), (3, "q", 4, 4.0, 4))])), last)
    assert [(r[2], r[4], r[5]) for r in out] == [(1, "late", 0), (3, "reset", 4)] and last[0] == 3


def test_idle_keys_expire_across_restarts(spark):
    """State lives through restarts; a key that is silent for the time to live counts as new, others do not; null counters are 0."""
    src, out = tempfile.mkdtemp(prefix="fleetlint-stream-ttl-"), tempfile.mkdtemp(prefix="fleetlint-stream-ttl-out-")

    def arrive(no, ts, *rows):
        df = spark.createDataFrame([(no, 0, q, f"q{q}", c, c, float(c) if c is not None else None) for q, c in rows],
                                   "snapshot_no int, instance_id bigint, queryid bigint, query string, calls bigint, row_count bigint, total_exec_time double")
        df.withColumn("snapshot_ts", F.to_timestamp(F.lit(ts))).coalesce(1).write.mode("append").parquet(src)
        q = (S.stream_stmt_delta(spark, src, ttl_ms=3600_000, watermark="10 minutes").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", out + "/ckpt").option("path", out + "/data").trigger(availableNow=True).start())
        q.awaitTermination()

    arrive(1, "2026-01-01 00:00:00", (1, 5), (2, None), (3, 7))
    arrive(2, "2026-01-01 00:30:00", (1, 6), (2, 4))                 # restart: key 3 stays silent
    arrive(3, "2026-01-01 01:25:00", (1, 9))                         # watermark 01:15: key 3 was due at 01:00, key 2 is due at 01:30
    arrive(4, "2026-01-01 01:26:00", (2, 5), (3, 8))
    got = {(r.snapshot_no, r.stmt_key): (r.status, r.delta_calls) for r in spark.read.parquet(out + "/data").collect()}
    assert got == {(1, "1"): ("new", 5), (1, "2"): ("new", 0), (1, "3"): ("new", 7), (2, "1"): ("changed", 1), (2, "2"): ("changed", 4),
                   (3, "1"): ("changed", 3), (4, "2"): ("changed", 1), (4, "3"): ("new", 8)}
