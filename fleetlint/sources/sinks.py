"""Sinks (sink_findings, sink_report_json)."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Arrow functions of this module run in Python workers: ship them by
# value so executors need not have the package installed.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


def write_findings(findings: DataFrame, path: str, run_ts: str | None = None, mode: str = "append") -> None:
    """Append findings partitioned by snapshot date and severity; ``run_ts``
    (default: now) tags the run so history is kept in one table."""
    ts = F.to_timestamp(F.lit(run_ts)) if run_ts else F.current_timestamp()
    out = findings.withColumn("run_ts", ts)
    date = F.to_date("snapshot_ts") if "snapshot_ts" in findings.columns else F.to_date(ts)
    out = out.withColumn("snapshot_date", date)
    out.write.mode(mode).partitionBy("snapshot_date", "severity").parquet(path)


def report_parts(verdicts: DataFrame, status: DataFrame, findings: DataFrame, part_findings: int = 100_000) -> DataFrame:
    """(keys..., part, line, value): the lines of every instance's report document.

    A document holds ``meta`` (the keys), ``summary`` (counts and verdict) and ``results``: one entry a check in run order with
    its name, category, whether it passed or was skipped, reason or error, and its ``findings`` by severity and
    object, each with its texts and metadata.  Checks and findings are range-partitioned by instance and place and
    streamed into lines, one finding a line, so no value holds a document.  An instance with more than
    ``part_findings`` findings continues in parts 2, 3, ...; each part is a document of its own whose ``results`` go on."""
    keys = [c for c in ("instance_id", "snapshot_ts") if c in findings.columns and c in verdicts.columns]
    none = F.lit(None).cast("string")
    head = verdicts.select(*keys, F.lit(0).alias("__kind"), F.lit("").alias("category"), F.lit("").alias("check_name"), F.lit(0).alias("__rank"), F.lit("").alias("object_name"),
                           F.to_json(F.struct(*[c for c in verdicts.columns if c not in keys])).alias("body"))
    entry = status.select(*keys, F.lit(1).alias("__kind"), "category", "check_name", F.lit(-1).alias("__rank"), F.lit("").alias("object_name"),
                          F.to_json(F.struct("check_name", "category", (F.col("status") == "passed").alias("passed"), (F.col("status") == "skipped").alias("skipped"), "skip_reason", "error")).alias("body"))
    found = findings.select(*keys, F.lit(1).alias("__kind"), "category", "check_name", F.col("severity_rank").cast("int").alias("__rank"),
                            F.coalesce("object_name", F.lit("")).alias("object_name"),
                            F.to_json(F.struct("severity", "title", "detail", "object_name", F.coalesce("remediation", none).alias("remediation"), "metadata")).alias("body"))
    rows = head.unionByName(entry).unionByName(found)
    from ..checks.registry import CATEGORIES
    index = F.create_map(*[F.lit(x) for kv in zip(CATEGORIES, range(len(CATEGORIES))) for x in kv])
    rows = rows.withColumn("__category", F.coalesce(F.element_at(index, F.col("category")), F.lit(len(CATEGORIES))))
    order = [*keys, "__kind", "__category", "check_name", "__rank", "object_name", "body"]
    # findings of one instance spread over tasks; a finding's part follows from its rank, so every task knows where it writes
    from ..operators.relops import distributed_rank
    place = distributed_rank(rows, keys, [F.col(c) for c in order[len(keys):]], "place")
    place = place.withColumn("part", F.floor((F.col("place") - 1) / part_findings).cast("int") + 1)
    n = len(keys)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("part", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("value", T.StringType())])

    def lines(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        import pyarrow as pa
        arrow = to_arrow_schema(schema)
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

        def texts():
            for key, own in itertools.groupby(stream, key=lambda r: r[:n + 1]):
                yield *key, '{"meta": ' + json.dumps({"part": key[n], **{k: str(v) for k, v in zip(keys, key)}}) + ","
                opened = check = finding = False
                for kind, rank, name, body in (r[n + 1:] for r in own):
                    if kind == 0:
                        yield *key, '"summary": ' + body + ","
                        continue
                    if not opened:
                        yield *key, '"results": ['
                        opened = True
                    if rank < 0:
                        yield *key, ("]}," if check else "") + body[:-1] + ', "findings": ['
                        check, finding = True, False
                    else:
                        if not check:                    # a part that goes on inside a check
                            yield *key, '{"check_name": ' + json.dumps(name) + ', "continued": true, "findings": ['
                            check = True
                        yield *key, ("," if finding else "") + body
                        finding = True
                yield *key, ("" if opened else '"results": [') + ("]}" if check else "") + "]}"

        rows_ = ((*r[:-1], i, r[-1]) for i, r in enumerate(texts()))
        while block := list(itertools.islice(rows_, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), arrow.types)], schema=arrow)

    return (place.select(*keys, "part", "__kind", "__rank", "check_name", "body", "place").repartition(*keys, "part").sortWithinPartitions(*keys, "part", "place")
                 .select(*keys, "part", "__kind", "__rank", "check_name", "body").mapInArrow(lines, schema))


def write_report_json(verdicts: DataFrame, status: DataFrame, findings: DataFrame, path: str, mode: str = "overwrite", part_findings: int = 100_000) -> None:
    """One nested JSON document per instance (and snapshot, where findings carry one) in a folder of its own, in numbered parts above
    ``part_findings`` findings; see ``report_parts``."""
    out = report_parts(verdicts, status, findings, part_findings)
    keys = [c for c in out.columns if c not in ("part", "line", "value")]
    # a part's lines are in one task; sorted by part and line, the writer keeps their order
    out.sortWithinPartitions(*keys, "part", "line").drop("line").write.mode(mode).partitionBy(*keys, "part").text(path)
