"""SQL-pattern checks over statement statistics.

One pass over the statement table computes a ``classes`` array per
statement from the pattern rule table (r_regex_scan); the five checks are
filters of that array, never five scans with their own regexes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import cut
from ..operators.relops import group_list_preview
from .common import CONSIDER, INFO, WARNING, current_statements, facts_frame
from .registry import register_check
from .rules import matched_classes, statement_rules

# DDL phrases and statement patterns (case-insensitive; `.` spans newlines).
DDL_PHRASES = [
    "CREATE TABLE", "ALTER TABLE", "DROP TABLE",
    "CREATE INDEX", "DROP INDEX",
    "CREATE VIEW", "DROP VIEW", "ALTER VIEW",
    "CREATE FUNCTION", "DROP FUNCTION", "ALTER FUNCTION",
    "CREATE PROCEDURE", "DROP PROCEDURE", "ALTER PROCEDURE",
    "CREATE TRIGGER", "DROP TRIGGER",
    "CREATE TYPE", "DROP TYPE", "ALTER TYPE",
    "CREATE SCHEMA", "DROP SCHEMA",
    "CREATE SEQUENCE", "ALTER SEQUENCE", "DROP SEQUENCE",
]
STATEMENT_PATTERNS = [
    ("truncate_cascade", r"(?is)TRUNCATE.*CASCADE"),
    ("truncate_restart", r"(?is)TRUNCATE.*RESTART"),
    ("ddl", "(?is)" + "|".join(DDL_PHRASES)),
    ("advisory_lock", r"(?is)pg_advisory_lock|pg_try_advisory_lock"),
    ("concurrent_index", r"(?is)CREATE\s+INDEX\s+CONCURRENTLY"),
    ("temp_table", r"(?is)CREATE\s+(TEMP|TEMPORARY)\s+TABLE"),
]
EXAMPLE_CHARS = {"ddl": 120, "concurrent_index": 150, "temp_table": 150}
EXAMPLES = 10


def classify_statements(cat):
    """Newest statement counters per instance with their pattern classes."""
    return cat.memo(("classified_statements",), lambda: current_statements(cat).withColumn(
        "classes", matched_classes(F.col("query"), statement_rules(cat, STATEMENT_PATTERNS))))


def pattern_statements(cat):
    """Every matched statement with its whole text: the rows behind the checks' counts and previews."""
    s = classify_statements(cat)
    return s.select(*cat.keys, F.explode("classes").alias("pattern"), F.col("calls").cast("bigint").alias("calls"), "query")


def _of(cat, cls: str):
    return classify_statements(cat).filter(F.array_contains("classes", cls))


def _examples(cat, cls: str):
    s = _of(cat, cls).withColumn(
        "example", F.format_string("[%d calls] %s", F.col("calls"), cut("query", EXAMPLE_CHARS[cls])))
    return group_list_preview(s, cat.keys, "example", [F.col("calls").desc(), F.col("query").asc()],
                              show=EXAMPLES, keep=EXAMPLES)


@register_check("truncate_cascade", "sql_patterns", needs=("instances",),
                description="TRUNCATE CASCADE / RESTART IDENTITY in statement history",
                title=lambda: F.when(F.col("pattern") == "no_statistics", F.lit("Truncates are unknown: no statement statistics were read"))
                .when(F.col("pattern") == "cascade", F.format_string(
                    "A truncate with cascade ran %d times", F.col("calls")))
                .otherwise(F.format_string("A truncate that restarts sequences ran %d times", F.col("calls"))),
                remediation=lambda: F.when(F.col("pattern") == "cascade", F.lit(
                    "List dependent tables explicitly instead of CASCADE; cascaded truncates are applied per node."))
                .otherwise(F.lit("Sequence restarts are node-local; coordinate them on all nodes.")))
def truncate_cascade(cat):
    """Truncates that cascade or restart sequences; an INFO row for every instance without statement statistics."""
    nulls = {"pattern": F.lit("no_statistics"), "query": F.lit(None).cast("string"), "calls": F.lit(0).cast("bigint")}
    if not cat.has("stat_statements"):
        return facts_frame(cat.instances(), cat.keys, F.lit("pg_stat_statements"), F.lit(INFO), **nulls)
    read = cat["stat_statements"].select(*cat.keys).distinct()
    none = facts_frame(cat.instances().select(*cat.keys).join(read, cat.keys, "left_anti"), cat.keys, F.lit("pg_stat_statements"), F.lit(INFO), **nulls)
    s = classify_statements(cat)
    c = facts_frame(s.filter(F.array_contains("classes", "truncate_cascade")), cat.keys, F.lit("(query)"),
                    F.lit(WARNING), pattern=F.lit("cascade"), query=F.col("query"), calls=F.col("calls"))
    r = facts_frame(s.filter(F.array_contains("classes", "truncate_restart")), cat.keys, F.lit("(query)"),
                    F.lit(CONSIDER), pattern=F.lit("restart"), query=F.col("query"), calls=F.col("calls"))
    return c.unionByName(r).unionByName(none)


@register_check("ddl_statements", "sql_patterns", needs=("stat_statements",),
                description="DDL in statement history needs DDL replication or coordination",
                title=lambda: F.format_string("%d different schema changes ran",
                                              F.col("pattern_count")),
                remediation=lambda: F.lit("Enable automatic DDL replication, or run DDL through "
                                          "spock.replicate_ddl_command()."))
def ddl_statements(cat):
    g = _examples(cat, "ddl")
    return facts_frame(g, cat.keys, F.lit("(queries)"), F.lit(CONSIDER),
                       pattern_count=F.col("count").cast("bigint"), examples=F.array_join("kept", "\n"))


@register_check("advisory_locks", "sql_patterns", needs=("stat_statements",),
                description="Advisory locks are node-local",
                title=lambda: F.format_string("Advisory locks were taken %d times", F.col("calls")),
                remediation=lambda: F.lit("Advisory locks do not coordinate across nodes; use a "
                                          "distributed lock or keep the workload on one node."))
def advisory_locks(cat):
    s = _of(cat, "advisory_lock")
    return facts_frame(s, cat.keys, F.lit("(query)"), F.lit(CONSIDER), query=F.col("query"),
                       calls=F.col("calls"))


@register_check("concurrent_indexes", "sql_patterns", needs=("stat_statements",),
                description="CREATE INDEX CONCURRENTLY is not replicated by DDL replication",
                title=lambda: F.format_string("%d different index builds without a lock ran",
                                              F.col("pattern_count")),
                remediation=lambda: F.lit("Run CREATE INDEX CONCURRENTLY on each node separately."))
def concurrent_indexes(cat):
    g = _examples(cat, "concurrent_index")
    return facts_frame(g, cat.keys, F.lit("(queries)"), F.lit(WARNING),
                       pattern_count=F.col("count").cast("bigint"), examples=F.array_join("kept", "\n"))


@register_check("temp_table_queries", "sql_patterns", needs=("stat_statements",),
                description="Temporary tables in statement history",
                title=lambda: F.format_string("%d different statements made temporary tables", F.col("pattern_count")))
def temp_table_queries(cat):
    g = _examples(cat, "temp_table")
    return facts_frame(g, cat.keys, F.lit("(queries)"), F.lit(INFO),
                       pattern_count=F.col("count").cast("bigint"), examples=F.array_join("kept", "\n"))
