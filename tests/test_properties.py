"""Metamorphic properties, skip handling, plan assertions and verdict cases."""
import tempfile
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlint.checks.registry import get, select_checks
from fleetlint.operators import relops
from fleetlint.plans import report
from fleetlint.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"


def _dup_catalog(spark):
    """Instance 0 copied as instance 10 in every table."""
    base = Catalog.from_fixtures(spark, SF)

    def loader(t):
        def load():
            df = base[t]
            if "instance_id" not in df.columns:
                return df
            copy = df.filter(F.col("instance_id") == 0).withColumn("instance_id", F.lit(10).cast(df.schema["instance_id"].dataType))
            if t == "instances":
                copy = copy.withColumn("cluster_id", F.lit("cluster_x"))
            return df.unionByName(copy)
        return load
    return base, Catalog(spark, {t: loader(t) for t in base.available()})


@pytest.mark.parametrize("name", ["primary_keys", "missing_fk_indexes", "enum_types", "conflict_log",
                                  "sequence_audit", "truncate_cascade", "stored_procedures"])
def test_duplicated_instance_has_same_findings(spark, name):
    base, dup = _dup_catalog(spark)
    a = sorted(tuple(r) for r in get(name).fn(base).filter("instance_id = 0").drop("instance_id").collect())
    b = sorted(tuple(r) for r in get(name).fn(dup).filter("instance_id = 10").drop("instance_id").collect())
    assert a == b and len(a) > 0


def test_partition_count_changes_nothing(spark):
    cat = Catalog.from_fixtures(spark, SF)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        a = sorted(map(tuple, get("foreign_keys").fn(cat).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(tuple, get("foreign_keys").fn(Catalog.from_fixtures(spark, SF)).collect()))
    assert a == b


def test_missing_input_skips_checks(spark):
    cat = Catalog.from_fixtures(spark, SF).without("conflict_history", "stat_statements")
    st = report.check_status(cat)
    rows = {(r.check_name, r.status) for r in st.filter("instance_id = 1").collect()}
    assert ("conflict_log", "skipped") in rows and ("ddl_statements", "skipped") in rows
    assert ("wal_level", "failed") in rows
    assert all(s in ("passed", "failed", "skipped") for _, s in rows) and len(rows) == 57


def test_no_python_udf_or_cartesian_in_check_plans(spark):
    cat = Catalog.from_fixtures(spark, SF)
    cat.materialize()     # plans start at checkpointed leaves, so only check logic is inspected
    for spec in select_checks():
        plan = spec.fn(cat)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, spec.name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, spec.name


@pytest.mark.parametrize("counts,verdict", [((0, 0, 3, 9), "READY"), ((0, 2, 0, 0), "CONDITIONALLY READY"),
                                             ((1, 0, 0, 0), "NOT READY"), ((0, 0, 0, 0), "READY")])
def test_verdict_cases(spark, counts, verdict):
    df = spark.createDataFrame([(1,) + counts], "instance_id long, critical long, warning long, consider long, info long")
    assert report.verdict(df).collect()[0].verdict == verdict


def test_todo_list_only_with_remediation(spark):
    cat = Catalog.from_fixtures(spark, SF)
    f = report.run_findings(cat, include_only=["conflict_log", "primary_keys", "event_triggers"])
    t = report.todo_list(f, include_consider=True)
    names = {r.check_name for r in t.collect()}
    assert "conflict_log" not in names and "primary_keys" in names
    assert t.filter(F.col("remediation").isNull()).count() == 0


def test_check_errors_are_captured(spark):
    """A check whose input lacks a column it reads is reported as error; the rest still run."""
    base = Catalog.from_fixtures(spark, SF)
    loaders = {t: (lambda t=t: base[t]) for t in base.available()}
    loaders["cat_trigger"] = lambda: base["cat_trigger"].drop("tgenabled")
    cat = Catalog(spark, loaders)
    errors: dict = {}
    f = report.run_findings(cat, errors=errors)
    assert set(errors) == {"trigger_functions"} and "tgenabled" in errors["trigger_functions"]
    st = {r.check_name: (r.status, r.error) for r in report.check_status(cat, f, errors=errors)
          .filter("instance_id = 1").collect()}
    assert st["trigger_functions"][0] == "error" and st["wal_level"] == ("failed", None)


def test_isolated_checks(spark):
    """A check that fails in a task, one that cannot be built and one without its folder cost only their own rows."""
    from fleetlint.checks import registry
    base = Catalog.from_fixtures(spark, SF)
    root = tempfile.mkdtemp(prefix="fleetlint-isolated-")
    names = ["instances", "cat_namespace", "cat_class", "cat_constraint", "settings", "cat_trigger", "cat_proc"]
    for t in names:
        df = base[t].drop("tgenabled") if t == "cat_trigger" else base[t]
        df.write.parquet(f"{root}/{t}")
    cat = Catalog.from_path(spark, root, tables=[*names, "conflict_history"], keys=["instance_id"])

    @registry.register_check("breaks_in_a_task", "schema", needs=("cat_class",))
    def breaks(cat):
        return cat["cat_class"].select("instance_id", "relname", F.raise_error(F.lit("no such page")).cast("string").alias("object_name"), F.lit("INFO").alias("severity"))
    try:
        run = report.run_isolated(cat, include_only=["breaks_in_a_task", "trigger_functions", "conflict_log", "primary_keys", "wal_level"])
        st = {r.check_name: (r.status, r.error, r.skip_reason) for r in report.check_status(cat, run.findings, errors=run.errors).filter("instance_id = 1").collect()}
    finally:
        del registry.REGISTRY["breaks_in_a_task"]
    assert st["breaks_in_a_task"][0] == "error" and "no such page" in st["breaks_in_a_task"][1]
    assert st["trigger_functions"][0] == "error" and "tgenabled" in st["trigger_functions"][1]
    assert st["conflict_log"] == ("skipped", None, "missing input: conflict_history") and st["primary_keys"][0] == "failed"
    for name in ("primary_keys", "wal_level"):
        got = sorted((r.instance_id, r.object_name) for r in run.findings.filter(F.col("check_name") == name).collect())
        assert got == sorted((r.instance_id, r.object_name) for r in get(name).fn(base).collect()) and got
    assert run.findings.filter("detail is null or title is null").count() == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_layout_needs_fewer_exchanges(spark):
    """Stored tables are bucketed by relation: joins by relation shuffle nothing; pruning by snapshot stays."""
    base = Catalog.from_fixtures(spark, SF)
    names = ["cat_class", "cat_namespace", "cat_attribute", "cat_constraint", "cat_index", "instances"]
    loaders = {t: (lambda t=t: base[t].withColumn("snapshot_date", F.lit("2026-12-01"))) for t in names}
    cat = Catalog(spark, loaders)
    prefix = "laid_" + uuid.uuid4().hex[:8] + "_"
    cat.save_layout(prefix, tempfile.mkdtemp(prefix="fleetlint-layout-"), 8, partition_by="snapshot_date")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = Catalog.from_layout(spark, prefix, snapshot_date="2026-12-01")
        stored = Catalog(spark, loaders).materialize().materialize_shared()
        few = many = 0
        for name in ("primary_keys", "missing_fk_indexes", "multiple_unique_indexes", "numeric_columns", "column_defaults"):
            plain, a, b = (get(name).fn(c) for c in (cat, laid, stored))
            want = sorted(map(str, plain.collect()))
            assert sorted(map(str, a.collect())) == want and sorted(map(str, b.collect())) == want
            many, few = many + _exchanges(plain), few + _exchanges(b)
        assert few < many / 2
        plan = laid["cat_class"]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_namespace_is_dealt_to_many_tasks(spark):
    cat = Catalog(spark, {"cat_namespace": lambda: spark.createDataFrame([(0, 1, "app")], "instance_id long, oid long, nspname string"),
                          "cat_class": lambda: spark.range(4000).selectExpr("0L as instance_id", "id as oid", "1L as relnamespace", "concat('t', id) as relname", "'r' as relkind")})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in cat.user_classes().groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 3000


def test_distributed_rank_and_first_k(spark):
    """One group of many rows is ranked by many tasks, without a window over it; first values and counts in one pass."""
    from pyspark.sql import Window

    from fleetlint.operators.relops import distributed_rank, first_k
    df = spark.range(20000).selectExpr("id % 7 = 6 as g", "cast(id * 7919 % 101 as int) as n", "concat('m', id) as name").repartition(5)
    order = [F.col("n").desc(), F.col("name").asc()]
    got = distributed_rank(df, ["g"], order, "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert sorted(map(tuple, got.select("g", "n", "name", "rank").collect())) == sorted(map(tuple, want.select("g", "n", "name", "rank").collect()))
    assert "Window [row_number" not in got._jdf.queryExecution().executedPlan().toString()
    k = {r.g: (r["count"], r.kept) for r in first_k(df.withColumn("v", F.when(F.col("n") % 2 == 0, F.col("name"))), ["g"], ["n", "name"], "v", 4).collect()}
    for g in (False, True):
        rows = sorted((r.n, r.name) for r in df.filter(F.col("g") == g).collect())
        assert k[g] == (len(rows), [name for n, name in rows if n % 2 == 0][:4])


def test_missing_statistics_are_told_per_instance(spark):
    base = Catalog.from_fixtures(spark, SF)
    some = {t: (lambda t=t: base[t]) for t in base.available()}
    some["stat_statements"] = lambda: base["stat_statements"].filter("instance_id <> 2")
    cat = Catalog(spark, some)
    rows = [r for r in get("truncate_cascade").fn(cat).collect() if r.pattern == "no_statistics"]
    assert [(r.instance_id, r.severity) for r in rows] == [(2, "INFO")]
    assert get("truncate_cascade").fn(cat.without("stat_statements")).count() == 5
    st = {r.instance_id: r.status for r in get("pg_stat_statements_check").fn(cat).collect()}
    ok = {r.instance_id: r.status for r in get("pg_stat_statements_check").fn(base).collect()}
    assert {i: s for i, s in st.items() if i != 2} == {i: s for i, s in ok.items() if i != 2}
    assert st[2] == ("unreadable" if ok[2] == "present" else "missing")


def test_rules_as_rows(spark):
    """A row in a rule table changes what the checks find; other rules stay."""
    base = Catalog.from_fixtures(spark, SF)
    tables = {t: (lambda t=t: base[t]) for t in base.available()}
    tables["rule_patterns"] = lambda: spark.createDataFrame([("truncate_cascade", r"(?i)select\s+1\b"), ("notices", "NOTIFY")], "class string, pattern string")
    tables["rule_keywords"] = lambda: spark.createDataFrame([("function_writes", "notify ")], "list string, keyword string")
    tables["rule_settings"] = lambda: spark.createDataFrame([("spock_gucs", "work_mem", "eq", "64MB", "WARNING"), ("wal_level", "wal_level", "eq", "no such level", "WARNING")],
                                                            "check_name string, name string, op string, target string, severity string")
    cat = Catalog(spark, tables)
    count = lambda c, name, cond: get(name).fn(c).filter(cond).count()
    assert count(cat, "truncate_cascade", "pattern = 'cascade'") > count(base, "truncate_cascade", "pattern = 'cascade'")
    assert count(cat, "truncate_cascade", "pattern = 'cascade' and query like 'SELECT 1%'") > 0
    assert count(cat, "ddl_statements", "true") == count(base, "ddl_statements", "true")
    from fleetlint.checks.sql_patterns import pattern_statements
    assert pattern_statements(cat).filter("pattern = 'notices'").count() > 0
    assert count(cat, "spock_gucs", "object_name = 'work_mem'") == 5 and count(base, "spock_gucs", "object_name = 'work_mem'") == 0
    assert count(cat, "wal_level", "severity = 'WARNING'") == 5
    assert count(cat, "stored_procedures", "writes like '%NOTIFY%'") > 0 and count(base, "stored_procedures", "writes like '%NOTIFY%'") == 0


def test_prefix_cover_compares_first_elements_before_slices(spark):
    """Null elements and empty lists are covered as by the slice alone, which is cut only behind the comparison of first elements."""
    left = spark.createDataFrame([(1, [1]), (1, []), (1, [None]), (1, [2, 3]), (1, [2, 4]), (2, [1]), (1, None)], "k int, want array<int>")
    right = spark.createDataFrame([(1, [1, 2]), (1, [None, 5]), (1, [2, 3, 4]), (1, None)], "r int, have array<int>")
    out = relops.prefix_cover_anti(left, right, ["k"], ["r"], "want", "have")
    assert sorted(map(str, out.collect())) == sorted(map(str, [Row(k=1, want=[2, 4]), Row(k=2, want=[1]), Row(k=1, want=None)]))
    assert "get(__r_arr" in out._jdf.queryExecution().toString()


def test_list_ordered_by_itself_is_held_once(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string").agg(relops.ordered_array_agg("x", "x").alias("v"))
    assert df.first()["v"] == [None, "a", "b", "b"]
    assert "o0" not in df._jdf.queryExecution().toString()
