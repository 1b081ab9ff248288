"""Named queries of the sources, sinks, streams and user checks: each writes data derived from the given tables to the
checkpoint folder and reads it back through the source, sink or stream it shows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks.common import facts_frame
from ..checks.registry import CheckSpec
from ..model import CONSIDER, to_findings
from ..oracles import activity as activity_sql
from ..oracles.checks_sql import SQL as CHECK_SQL
from ..session import scratch_dir
from ..sources.catalog import Catalog
from ..sources.sinks import write_findings, write_report_json
from ..sources.text import read_dump_lines, read_log_lines
from ..streaming import jobs
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHOWN = ["primary_keys", "wal_level", "spock_gucs"]


def _query(name: str, oracle: str):
    def deco(fn):
        def run(spark, sf_dir):
            return fn(spark, Catalog.from_fixtures(spark, sf_dir), scratch_dir(spark, f"tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"))
        run.__doc__ = fn.__doc__
        QUERIES[name], ORACLES[name] = run, oracle
        return fn
    return deco


def _as_files(lines: DataFrame, path: str) -> None:
    """One text file an instance, its lines by file and line number."""
    (lines.select("instance_id", "file_id", "line_no", "line").repartition("instance_id").sortWithinPartitions("instance_id", "file_id", "line_no")
          .select("instance_id", F.col("line").alias("value")).write.partitionBy("instance_id").text(path))


_LINES = "select instance_id, row_number() over (partition by instance_id order by file_id, line_no) as line_no, line from "


@_query("src_log_lines", _LINES + "log_lines")
def src_log_lines(spark, cat, path):
    """Server logs read from files: every line with its true number."""
    _as_files(cat["log_lines"], path)
    return read_log_lines(spark, path).select(F.col("instance_id").cast("bigint").alias("instance_id"), "line_no", "line")


@_query("src_dump_text", _LINES + "dump_lines")
def src_dump_text(spark, cat, path):
    """Schema dumps read from files: every line with its true number."""
    _as_files(cat["dump_lines"], path)
    return read_dump_lines(spark, path).select(F.col("instance_id").cast("bigint").alias("instance_id"), "line_no", "line")


@_query("src_catalog_snapshot", "select instance_id, oid, relname, relkind, nspname, fqn from uc")
def src_catalog_snapshot(spark, cat, path):
    """Relations of user namespaces, read from a stored layout that is bucketed by relation."""
    part = Catalog(spark, {t: (lambda t=t: cat[t]) for t in ("cat_class", "cat_namespace")})
    prefix = f"snap_{uuid.uuid4().hex}_"
    part.save_layout(prefix, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = Catalog.from_layout(spark, prefix)
    return laid.user_classes().select(F.col("instance_id").cast("bigint").alias("instance_id"), "oid", "relname", "relkind", "nspname", "fqn")


@_query("src_stat_snapshot", "select instance_id, cast(snapshot_no as integer) as snapshot_no, queryid, query, calls, row_count from stat_statements")
def src_stat_snapshot(spark, cat, path):
    """Statement counters read from stored snapshots, one folder a snapshot."""
    cat["stat_statements"].write.partitionBy("snapshot_no").parquet(f"{path}/stat_statements")
    s = Catalog.from_path(spark, path, tables=["stat_statements"], keys=["instance_id"])["stat_statements"]
    return s.select(F.col("instance_id").cast("bigint").alias("instance_id"), F.col("snapshot_no").cast("int").alias("snapshot_no"), "queryid", "query", "calls", "row_count")


_SHOWN_SQL = "\nunion all\n".join(f"select instance_id, '{n}' as check_name, severity, object_name from ({CHECK_SQL[n]}) q_{n}" for n in SHOWN)


@_query("sink_findings", f"with af as ({_SHOWN_SQL})\nselect instance_id, check_name, severity, count(*) as findings from af group by all")
def sink_findings(spark, cat, path):
    """Findings appended to the partitioned history and read back, counted by check and severity."""
    write_findings(report.run_isolated(cat, include_only=SHOWN).findings, path, run_ts="2026-12-01 00:00:00")
    back = spark.read.parquet(path).filter(F.col("snapshot_date") == F.lit("2026-12-01").cast("date"))
    return back.groupBy("instance_id", "check_name", "severity").agg(F.count(F.lit(1)).alias("findings"))


@_query("sink_report_json", f"with af as ({_SHOWN_SQL})\nselect instance_id, check_name, severity, object_name from af")
def sink_report_json(spark, cat, path):
    """The findings inside the nested report documents, read back from the documents."""
    run = report.run_isolated(cat, include_only=SHOWN)
    status = report.check_status(cat, run.findings, errors=run.errors).filter(F.col("check_name").isin(SHOWN))
    write_report_json(report.verdict(report.severity_counts(cat, run.findings)), status, run.findings, path, part_findings=1000)
    shape = "array<struct<check_name:string,findings:array<struct<severity:string,object_name:string>>>>"
    docs = spark.read.text(path, wholetext=True)
    checks = docs.select(F.col("instance_id").cast("bigint").alias("instance_id"), F.explode(F.from_json(F.get_json_object("value", "$.results"), shape)).alias("r"))
    return checks.select("instance_id", "r.check_name", F.explode("r.findings").alias("f")).select("instance_id", "check_name", "f.severity", "f.object_name")


def _drained(stream: DataFrame, path: str) -> DataFrame:
    """A stream run over all files that are there, and what it has written."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@_query("stream_stmt_delta", f"""
with k as ({activity_sql.STMT_KEY}),
p as (select *, lag(calls) over w as b_calls, lag(total_exec_time) over w as b_time, lag(row_count) over w as b_rows
      from k window w as (partition by instance_id, stmt_key order by snapshot_no)),
d as (select *, case when b_calls is null then 'new' when calls < b_calls then 'reset' else 'changed' end as status from p where b_calls is null or calls <> b_calls)
select instance_id, stmt_key, cast(snapshot_no as integer) as snapshot_no, query, status, case when status = 'changed' then calls - b_calls else calls end as delta_calls,
       case when status = 'changed' then row_count - b_rows else row_count end as delta_rows from d""")
def stream_stmt_delta(spark, cat, path):
    """Statement counters streamed from snapshot files: the increase of every statement."""
    s = cat["stat_statements"].select(F.col("snapshot_no").cast("int"), F.col("instance_id").cast("bigint"), F.col("queryid").cast("bigint"), "query",
                                      F.col("calls").cast("bigint"), F.col("row_count").cast("bigint"), F.col("total_exec_time").cast("double"))
    s.withColumn("snapshot_ts", F.timestamp_seconds(F.lit(1767225600) + F.col("snapshot_no") * 3600)).write.parquet(f"{path}/in")
    return _drained(jobs.stream_stmt_delta(spark, f"{path}/in"), path).drop("delta_time")


_HEADS = activity_sql._ENTRIES.split(",\nc as (")[0]


@_query("stream_log_classes", f"""with {_HEADS},
e as (select instance_id, file_id, entry_no, line_no, ts, stmt as text from h2 where stmt <> ''),
{activity_sql._CLASSES}
select instance_id, class, strftime(time_bucket(interval 1 hour, cast(substr(ts, 1, 19) as timestamp)), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n
from cl group by all""")
def stream_log_classes(spark, cat, path):
    """Server logs streamed from files: classes counted by hour; a later line of every instance closes the windows."""
    last = cat.instances().select("instance_id", F.lit(1 << 60).alias("file_id"), F.lit(1).alias("line_no"), F.lit("2030-01-01 00:00:00 UTC [1] LOG:  statement: DROP TABLE t").alias("line"))
    types = dict(cat["log_lines"].dtypes)
    lines = cat["log_lines"].select("instance_id", F.col("file_id").cast("bigint").alias("file_id"), "line_no", "line")
    _as_files(lines.unionByName(last.select("instance_id", F.col("file_id").cast("bigint"), F.col("line_no").cast(types["line_no"]), "line")), f"{path}/in")
    out = _drained(jobs.stream_log_classes(spark, f"{path}/in"), path)
    return out.select("instance_id", "class", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@_query("register_check", """
with w as (select c.instance_id, c.fqn, count(*) as columns from uc c join cat_attribute a on a.instance_id = c.instance_id and a.attrelid = c.oid
           where a.attnum > 0 group by c.instance_id, c.fqn having count(*) >= 3)
select instance_id, 'wide_tables' as check_name, 'CONSIDER' as severity, fqn as object_name, columns || ' columns' as title,
       'Tables with many columns. Object: ' || fqn || '; columns: ' || columns as detail from w""")
def user_check(spark, cat, path):
    """A check of a user's own, rendered in the uniform shape like the built-in ones."""
    def wide(cat):
        n = cat["cat_attribute"].filter("attnum > 0").join(cat.user_classes().withColumnRenamed("oid", "attrelid"), cat.keys + ["attrelid"]).groupBy(*cat.keys, "fqn").count()
        return facts_frame(n.filter("count >= 3"), cat.keys, F.col("fqn"), F.lit(CONSIDER), columns=F.col("count"))

    spec = CheckSpec("wide_tables", "schema", "scan", "Tables with many columns", wide, ("cat_attribute",), title=lambda: F.format_string("%d columns", F.col("columns")))
    return to_findings(spec, spec.fn(cat), cat.keys).select("instance_id", "check_name", "severity", "object_name", "title", "detail")
