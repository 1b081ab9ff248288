"""Run composition and report rollups.

``run_isolated`` runs every check as a job of its own that appends to one
findings table, so a failing check costs its own rows only.  ``run_findings``
unions the findings of the selected checks into one lazy plan instead.
The rollups are aggregations of that findings table, always starting from
the ``instances`` dimension so zero rows are kept.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks.registry import CheckSpec, select_checks
from ..model import CONSIDER, CRITICAL, INFO, SEVERITIES, WARNING, findings_schema, severity_rank, to_findings
from ..session import scratch_dir

# Which findings carry a remediation (SQL predicate over the
# check's facts columns; the default is "severity is not INFO").
REMEDIATION_RULES = {
    "conflict_log": "false",
    "exception_log": "kind = 'group'",
    "repset_membership": "object_name <> 'spock'",
    "subscription_health": "kind in ('disabled', 'slot_inactive')",
    "notify_listen": "source = 'function'",
    "installed_extensions": "severity = 'WARNING'",
    "trigger_functions": "enabled in ('A', 'R')",
    "event_triggers": "enabled in ('A', 'R')",
    "snowflake_ext": "status in ('available', 'unavailable')",
    "spock_gucs": "status = 'mismatch'",
    "stored_procedures": "object_name <> '(functions)'",
    "lolor_check": "status <> 'ok'",
    "pg_version": "severity in ('CRITICAL', 'WARNING')",
}
DEFAULT_REMEDIATION_RULE = "severity <> 'INFO'"
VERDICTS = ["READY", "CONDITIONALLY READY", "NOT READY"]


def remediation_rule(check: str) -> str:
    return REMEDIATION_RULES.get(check, DEFAULT_REMEDIATION_RULE)


def runnable(cat, specs: list[CheckSpec]) -> tuple[list[CheckSpec], dict[str, str]]:
    """Checks whose inputs exist; others map to a skip reason."""
    ok, skipped = [], {}
    for s in specs:
        missing = [t for t in s.needs if not cat.has(t)]
        if missing:
            skipped[s.name] = "missing input: " + ", ".join(missing)
        else:
            ok.append(s)
    return ok, skipped


def check_findings(spec: CheckSpec, cat) -> DataFrame:
    """One check's findings in the uniform shape."""
    return to_findings(spec, spec.fn(cat), cat.keys, F.expr(remediation_rule(spec.name)))


def run_findings(cat, mode: str | None = None, categories=None, exclude=None, include_only=None,
                 cache_inputs: bool = False, errors: dict | None = None) -> DataFrame:
    """All findings of the selected, runnable checks as one DataFrame.

    With an ``errors`` dict, a check whose plan cannot be built (for example
    an input table without a column the check reads) is recorded there with
    its message and left out; the other checks still run."""
    specs, _ = runnable(cat, select_checks(mode, categories, exclude, include_only))
    if cache_inputs:
        persist_inputs(cat, specs)
    # Each check is an independent plan; build them concurrently on the driver
    # (pure planning work: eager analysis in the JVM, no data is touched).
    def build(spec):
        try:
            return check_findings(spec, cat)
        except Exception as e:  # analysis errors surface while the plan is built
            if errors is None:
                raise
            errors[spec.name] = f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300]}"
            return None

    with ThreadPoolExecutor(max_workers=min(8, len(specs))) as pool:
        parts = [p for p in pool.map(build, specs) if p is not None]
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union in a balanced tree: each union analyses a plan of log depth."""
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0]


def persist_inputs(cat, specs: list[CheckSpec], tolerant: bool = False) -> None:
    """Store derived catalog tables that two or more checks read, co-located by relation (see
    ``Catalog.materialize``): each is derived once, and the checks plan on a leaf."""
    use: dict[str, int] = {}
    for s in specs:
        for t in s.needs:
            use[t] = use.get(t, 0) + 1
    use["instances"] = use.get("instances", 0) + 2
    cat.materialize([t for t, n in use.items() if n > 1 and cat.has(t)], tolerant)
    if cat.has("cat_class") and cat.has("cat_namespace"):
        cat.materialize_shared(tolerant)


class ChecksFailed(RuntimeError):
    """Checks of a run failed, so what they would have found is not known."""

    def __init__(self, errors: dict[str, str]):
        super().__init__(f"{len(errors)} failed: " + "; ".join(f"{n}: {errors[n]}" for n in sorted(errors)))
        self.errors = dict(errors)


@dataclass
class Run:
    """What a run of checks left behind: its findings table, and the checks that gave none and why."""

    findings: DataFrame
    errors: dict[str, str]
    skipped: dict[str, str]

    def whole(self) -> DataFrame:
        """The findings, for results that have no place for an error: a failed check raises ``ChecksFailed``,
        since without its rows they would read as if it had found nothing."""
        if self.errors:
            raise ChecksFailed(self.errors)
        return self.findings


def run_isolated(cat, mode: str | None = None, categories=None, exclude=None, include_only=None,
                 path: str | None = None, workers: int = 8, store_inputs: bool = True) -> Run:
    """Run every selected check as a job of its own and append to one findings table.

    A check that cannot be built, or fails while it runs, is recorded with its
    message and leaves no rows; all others keep theirs.  A check whose inputs
    are not there (no loader, or no folder in its file system) is skipped.
    Jobs run side by side in fair-scheduler pools, one a check.  ``path``
    names the table's folder (default: the checkpoint folder); derived inputs that
    several checks read are stored once before (``store_inputs``)."""
    specs, skipped = runnable(cat, select_checks(mode, categories, exclude, include_only))
    spark, errors = cat.spark, {}
    path = (path or scratch_dir(spark, f"tables/{spark.sparkContext.applicationId}/findings-{uuid.uuid4().hex}")).rstrip("/")

    def message(e: Exception) -> str:
        return f"{type(e).__name__}: {next(iter(str(e).strip().splitlines()), '')[:300]}"

    if store_inputs:
        persist_inputs(cat, specs, tolerant=True)     # an input that cannot be read fails in the checks that need it

    def run(spec: CheckSpec):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", spec.name)
        try:
            out = check_findings(spec, cat)
            out.drop("check_name").write.mode("append").parquet(f"{path}/check_name={spec.name}")
            return out.schema
        except Exception as e:
            errors[spec.name] = message(e)
            return None
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(specs) or 1))) as pool:
        schemas = [x for x in pool.map(run, specs) if x is not None]
    if schemas:
        cols = [f for f in schemas[0].fields]
        found = spark.read.schema(T.StructType(cols)).parquet(path).select(*[f.name for f in cols])
    else:
        found = spark.createDataFrame([], findings_schema(cat.keys))
    return Run(found, errors, skipped)


def check_status(cat, findings: DataFrame | None = None, mode: str | None = None,
                 errors: dict | None = None) -> DataFrame:
    """Per instance and check: passed / failed (with findings) / error (the check could not be
    built or its job failed, with message) / skipped (missing input, with reason).

    Without ``findings`` the checks are run, each as a job of its own."""
    k = cat.keys
    specs = select_checks(mode)
    ok, skipped = runnable(cat, specs)
    errors = {} if errors is None else errors
    if findings is None:
        run = run_isolated(cat, mode)
        findings, errors = run.findings, run.errors
    counts = findings.groupBy(*k, "check_name").agg(F.count(F.lit(1)).alias("finding_count"))
    rows = F.array(*[F.struct(F.lit(s.name).alias("check_name"), F.lit(s.category).alias("category"),
                              F.lit(skipped.get(s.name)).cast("string").alias("skip_reason"),
                              F.lit(errors.get(s.name)).cast("string").alias("error")) for s in specs])
    grid = cat.instances().select(*k, F.inline(rows))
    t = grid.join(counts, k + ["check_name"], "left").withColumn(
        "finding_count", F.coalesce("finding_count", F.lit(0)).cast("bigint"))
    status = (F.when(F.col("skip_reason").isNotNull(), F.lit("skipped"))
               .when(F.col("error").isNotNull(), F.lit("error"))
               .when(F.col("finding_count") > 0, F.lit("failed")).otherwise(F.lit("passed")))
    return t.select(F.col("instance_id").cast("bigint").alias("instance_id"),
                    *[c for c in k if c != "instance_id"], "check_name", "category",
                    status.alias("status"), "finding_count", "skip_reason", "error")


def severity_counts(cat, findings: DataFrame) -> DataFrame:
    """Findings per severity per instance, zeros filled (pivot over fixed values)."""
    k = cat.keys
    piv = findings.groupBy(*k).pivot("severity", SEVERITIES).agg(F.count(F.lit(1)))
    t = cat.instances().select(*k).join(piv, k, "left")
    return t.select(F.col("instance_id").cast("bigint").alias("instance_id"),
                    *[c for c in k if c != "instance_id"],
                    *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s.lower()) for s in SEVERITIES])


def verdict(counts: DataFrame) -> DataFrame:
    v = (F.when((F.col("critical") == 0) & (F.col("warning") == 0), F.lit("READY"))
          .when(F.col("critical") == 0, F.lit("CONDITIONALLY READY")).otherwise(F.lit("NOT READY")))
    return counts.withColumn("verdict", v)


def fleet_verdicts(verdicts: DataFrame) -> DataFrame:
    """Number of instances per verdict across the fleet (all three verdicts listed)."""
    vs = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    c = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("instances"))
    return F.broadcast(vs).join(c, "verdict", "left").select(
        "verdict", F.coalesce("instances", F.lit(0)).cast("bigint").alias("instances"))


def findings_grouped(cat, findings: DataFrame) -> DataFrame:
    """Counts by severity (in severity order), then category."""
    k = cat.keys
    return (findings.groupBy(*k, "severity_rank", "severity", "category")
            .agg(F.count(F.lit(1)).alias("finding_count"))
            .withColumn("severity_rank", F.col("severity_rank").cast("bigint")))


def todo_list(findings: DataFrame, include_consider: bool = False, severities: list[str] | None = None) -> DataFrame:
    """Findings with a remediation; ``severities`` names others than CRITICAL and WARNING (a log's DDL is INFO)."""
    sev = severities or [CRITICAL, WARNING] + ([CONSIDER] if include_consider else [])
    t = findings.filter(F.col("severity").isin(*sev) & F.col("remediation").isNotNull())
    keys = [c for c in ("instance_id", "snapshot_ts") if c in findings.columns]
    return t.select(*keys, "severity", F.col("severity_rank").cast("bigint").alias("severity_rank"),
                    "check_name", "category", "object_name", "remediation")


__all__ = ["run_findings", "check_status", "severity_counts", "verdict", "fleet_verdicts",
           "findings_grouped", "todo_list", "REMEDIATION_RULES", "remediation_rule", "INFO", "severity_rank"]
