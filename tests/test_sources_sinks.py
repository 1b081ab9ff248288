"""Sources and sinks: line order across splits, dump files, findings and report sinks."""
import glob
import json
import os
import re
import tempfile

from pyspark.sql import functions as F

from fleetlint.plans import activity as A
from fleetlint.sources.sinks import write_findings, write_report_json
from fleetlint.sources.text import read_dump_lines, read_log_lines


def test_log_lines_keep_order_across_splits(spark):
    root = tempfile.mkdtemp(prefix="fleetlint-logs-")
    for inst in (0, 1):
        d = os.path.join(root, f"instance_id={inst}")
        os.makedirs(d)
        with open(os.path.join(d, "pg.log"), "w") as fh:
            for i in range(4000):
                fh.write(f"2024-01-01 10:00:00 UTC [1] LOG:  statement: SELECT {i}\n\tcont {i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_log_lines(spark, root)
        assert lines.select("block").distinct().count() > 10
        assert {(r.instance_id, r.n, r.m) for r in lines.groupBy("instance_id").agg(F.countDistinct("line_no").alias("n"), F.max("line_no").alias("m")).collect()} == {(0, 8000, 8000), (1, 8000, 8000)}
        assert lines.filter("instance_id = 1 and line_no = 3").first().line.endswith("SELECT 1")
        wrong = lines.filter(F.col("line").startswith("\tcont") & (F.col("line") != F.concat(F.lit("\tcont "), (F.col("line_no") / 2 - 1).cast("int").cast("string"))))
        assert wrong.count() == 0
        e = A.log_assemble(lines, ["instance_id"], file_col="file_id", order_col="line_no", block_col="block")
        got = e.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col("text") != F.concat(
                                               F.lit("SELECT "), F.regexp_extract("text", r"SELECT (\d+)", 1),
                                               F.lit(" cont "), F.regexp_extract("text", r"SELECT (\d+)", 1)))
                                           .alias("bad")).collect()
        assert {(r.instance_id, r.n, r.bad) for r in got} == {(0, 4000, 0), (1, 4000, 0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dump_files(spark):
    root = tempfile.mkdtemp(prefix="fleetlint-dumps-")
    d = os.path.join(root, "instance_id=3")
    os.makedirs(d)
    with open(os.path.join(d, "schema.sql"), "w") as fh:
        fh.write("-- Dumped from database version 17.1\nCREATE TABLE public.t (\n    a int\n);\n")
    lines = read_dump_lines(spark, root).orderBy("line_no").collect()
    assert [r.line_no for r in lines][:4] == [1, 2, 3, 4] and lines[0].instance_id == 3


def test_dump_files_are_split(spark):
    """A dump over many splits: line numbers and statements as in the whole text, by more than one scan task."""
    from fleetlint.plans import dump as D
    root = tempfile.mkdtemp(prefix="fleetlint-dumps-")
    text = "-- Dumped from database version 17.1\nSET search_path = app;\n\nCREATE TABLE t0 (\n    a int\n);\nCOPY t0 (a) FROM stdin;\n"
    text += "".join(f"{i}\tdata; \r{'x' * (i % 50)}\n" for i in range(4000)) + "\\.\n"
    text += "".join(f"CREATE TABLE t{i} (\r\n    a int,\n    é text\n);\n\n" for i in range(1, 300))
    text += "CREATE FUNCTION f() RETURNS int AS $_$\n" + "select 1;\n" * 2000 + "$_$ LANGUAGE sql;\nCREATE SEQUENCE last_one;"
    for i in (3, 4):
        os.makedirs(os.path.join(root, f"instance_id={i}"))
        with open(os.path.join(root, f"instance_id={i}", "schema.sql"), "w", newline="") as fh:
            fh.write(text if i == 3 else "CREATE TABLE other (\n    a int\n);\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = read_dump_lines(spark, root)
        got = sorted((r.line_no, r.line) for r in lines.filter("instance_id = 3").collect())
        assert got == list(enumerate(text.split("\n"), 1))
        assert spark.read.text(root).rdd.getNumPartitions() > 4 and "wholetext" not in lines._jdf.queryExecution().toString().lower()
        st = {(r.instance_id, r.stmt_no): (r.kind, r.search_path, r.first_line) for r in D.dump_statements(lines, ["instance_id"], block_lines=1000).collect()}
        whole = spark.createDataFrame([(3, "f", i, x) for i, x in enumerate(text.split("\n"), 1)], "instance_id long, file_id string, line_no long, line string")
        want = {(r.instance_id, r.stmt_no): (r.kind, r.search_path, r.first_line) for r in D.dump_statements(whole, ["instance_id"]).collect()}
        assert {k: v for k, v in st.items() if k[0] == 3} == want and len(st) == len(want) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks_roundtrip(spark):
    from fleetlint.plans import report
    from fleetlint.sources.catalog import Catalog
    cat = Catalog.from_fixtures(spark, "/root/testdata/sf0.001")
    f = report.run_findings(cat, include_only=["primary_keys", "wal_level"])
    out = tempfile.mkdtemp(prefix="fleetlint-sink-")
    write_findings(f, out + "/findings", run_ts="2026-12-01 00:00:00")
    back = spark.read.parquet(out + "/findings")
    assert back.count() == f.count()
    assert set(back.columns) >= {"snapshot_date", "severity", "run_ts", "metadata"}
    v = report.verdict(report.severity_counts(cat, f))
    status = report.check_status(cat, f).filter("check_name in ('primary_keys', 'wal_level', 'unlogged_tables')")
    rows = [r.asDict() for r in f.collect()]

    def documents(path):
        return {(int(i), int(p)): json.loads(open(glob.glob(f"{path}/instance_id={i}/part={p}/*.txt")[0]).read())
                for i, p in (re.findall(r"instance_id=(\d+)/part=(\d+)", d)[0] for d in glob.glob(f"{path}/*/*"))}

    write_report_json(v, status, f, out + "/report")
    docs = documents(out + "/report")
    assert sorted(docs) == [(i, 1) for i in range(5)]
    for (i, _), d in docs.items():
        assert list(d) == ["meta", "summary", "results"] and d["summary"]["verdict"] in report.VERDICTS
        assert [r["check_name"] for r in d["results"]] == ["primary_keys", "unlogged_tables", "wal_level"]
        for r in d["results"]:
            own = [x for x in rows if x["instance_id"] == i and x["check_name"] == r["check_name"]]
            assert [x["object_name"] for x in r["findings"]] == [x["object_name"] for x in sorted(own, key=lambda x: (x["severity_rank"], x["object_name"]))]
            assert all(x["title"] and x["metadata"] is not None for x in r["findings"])
    # large documents go on in further parts
    write_report_json(v, status, f, out + "/parts", part_findings=10)
    parts = documents(out + "/parts")
    assert max(p for _, p in parts) > 1
    for i in range(5):
        whole = [(r["check_name"], x["object_name"]) for _, d in sorted((k, d) for k, d in parts.items() if k[0] == i) for r in d["results"] for x in r["findings"]]
        assert whole == [(r["check_name"], x["object_name"]) for r in docs[(i, 1)]["results"] for x in r["findings"]]
