"""Activity over time: statement-counter deltas and log analysis.

Batch jobs over ``stat_statements`` snapshots and ``log_lines``.  The
streaming variants live in ``fleetlint.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks.registry import CheckSpec
from ..functions.scalar import cut
from ..model import INFO, WARNING, to_findings
from ..operators.relops import first_k

# How many examples a finding shows, and their length in characters.
NEW_EXAMPLES, NEW_EXAMPLE_CHARS = 20, 150
LOG_EXAMPLES, LOG_EXAMPLE_CHARS = {"truncate_cascade": 10, "concurrent_index": 10, "ddl": 20}, 150
LOG_CLASS_SEVERITY = {"truncate_cascade": WARNING, "concurrent_index": WARNING, "ddl": INFO,
                      "advisory_lock": INFO, "temp_table": INFO}
# Statement verbs and the objects they act on.
DDL_VERBS = ["CREATE", "ALTER", "DROP"]
DDL_OBJECTS = ["TABLE", "INDEX", "VIEW", "FUNCTION", "PROCEDURE", "TRIGGER", "TYPE", "SCHEMA", "SEQUENCE"]
DEFAULT_BLOCK_LINES = 1 << 20

# The server's log_line_prefix, of which the documentation lists these escapes: what each may print.
PREFIX_ESCAPES = {"m": r"(\S+ \S+ \S+)", "t": r"(\S+ \S+ \S+)", "p": r"\d+", "l": r"\d+", "x": r"\d+", "c": r"[\da-f]+\.[\da-f]+", "e": r"\w{5}",
                  "n": r"\d+\.\d+", "s": r"\S+ \S+ \S+", "v": r"\S*", "Q": r"-?\d+", "P": r"\d*", "q": "", "%": "%"}
DEFAULT_PREFIX = "%m [%p] "
# Message severities of the server, and those whose lines carry statements.
SEVERITIES = ["DEBUG1", "DEBUG2", "DEBUG3", "DEBUG4", "DEBUG5", "INFO", "NOTICE", "WARNING", "LOG", "ERROR", "FATAL", "PANIC", "STATEMENT", "DETAIL", "HINT", "CONTEXT"]
ENTRY_SEVERITIES = ["LOG", "STATEMENT", "ERROR"]


def prefix_pattern(prefix: str = DEFAULT_PREFIX) -> str:
    """Pattern of a line's prefix, severity and message (groups 1 to 3) for a ``log_line_prefix``.

    The prefix needs %m or %t; names (%u, %d, %a, %h, ...) may be any text."""
    out, i = "", 0
    while i < len(prefix):
        c = prefix[i]
        if c == "%" and i + 1 < len(prefix):
            i += 1
            while prefix[i] in "-0123456789":          # padding
                i += 1
            out += PREFIX_ESCAPES.get(prefix[i], ".*?")
        else:
            out += c if c.isalnum() or c == " " else "\\" + c
        i += 1
    return f"^{out}({'|'.join(SEVERITIES)}): +(.*)$"


def log_line(line: Column | str, prefix: str = DEFAULT_PREFIX) -> Column:
    """struct(ts, severity, message) of a header line that starts an entry; null for any other line."""
    c = F.col(line) if isinstance(line, str) else line
    rx = prefix_pattern(prefix)
    sev = F.regexp_extract(c, rx, 2)
    return F.when(sev.isin(ENTRY_SEVERITIES), F.struct(F.regexp_extract(c, rx, 1).alias("ts"), sev.alias("severity"), F.regexp_extract(c, rx, 3).alias("message")))


def logged_statement(message: Column) -> Column:
    """struct(is_statement, text) of a message: what follows ``statement:`` or ``execute <name>:``, else the message.

    A duration that the server puts before it is skipped."""
    m = F.when(message.startswith("duration: "), F.ltrim(F.substring_index(message, " ms", -1))).otherwise(message)
    label = F.substring_index(m, ":", 1)
    has = (label == "statement") | label.startswith("execute ")
    return F.struct(has.alias("is_statement"), F.when(has, F.ltrim(F.substr(m, F.length(label) + 2))).otherwise(message).alias("text"))


def plain_words(text: Column) -> Column:
    """The words of a statement in upper case, one space between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9_]+", " ")), F.lit(" "))


def has_phrase(words: Column, phrases: list[str]) -> Column:
    """Whether ``plain_words`` text holds one of the phrases as whole words."""
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(words, p))


def statement_classes(text: Column) -> Column:
    """Array of the classes of a logged statement; DDL that builds an index concurrently is concurrent_index alone."""
    w = plain_words(text)
    ddl = has_phrase(w, [f"{v} {o}" for v in DDL_VERBS for o in DDL_OBJECTS])
    concurrent = has_phrase(w, ["CREATE INDEX CONCURRENTLY"])
    cut_at = F.instr(w, " TRUNCATE ")
    rules = {"concurrent_index": ddl & concurrent, "ddl": ddl & ~concurrent,
             "truncate_cascade": (cut_at > 0) & F.contains(F.substr(w, cut_at + F.lit(9)), F.lit(" CASCADE ")),
             "temp_table": has_phrase(w, ["CREATE TEMP TABLE", "CREATE TEMPORARY TABLE"]),
             "advisory_lock": F.contains(w, F.lit(" PG_ADVISORY_LOCK")) | F.contains(w, F.lit(" PG_TRY_ADVISORY_LOCK"))}
    return F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in rules.items()]))


def observed_classes(text: Column) -> Column:
    """Array of the classes of a counted statement that an observation window reports."""
    up = F.regexp_replace(F.upper(text), r"\s+", " ")
    at = F.instr(up, "TRUNCATE")
    rules = {"truncate_cascade": (at > 0) & F.contains(F.substr(up, at + F.lit(8)), F.lit("CASCADE")),
             "concurrent_index": F.contains(up, F.lit("CREATE INDEX CONCURRENTLY"))}
    return F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in rules.items()]))


# -- statement counters ---------------------------------------------------------------
def stmt_key() -> Column:
    """The query id, else a hash of the whole text (texts with a common start stay apart)."""
    return F.coalesce(F.col("queryid").cast("string"), F.sha2(F.coalesce("query", F.lit("")), 256))


def stmt_keyed(stats: DataFrame, keys: list[str], combine: str = "sum") -> DataFrame:
    """One row per (keys, snapshot_no, stmt_key).

    Duplicate keys inside one snapshot (one statement of several users or
    databases): ``combine='sum'`` adds the counters up; ``combine='last'`` keeps
    the row with the fewest calls, ties broken by text.
    """
    s = stats.withColumn("stmt_key", stmt_key())
    g = s.groupBy(*keys, "snapshot_no", "stmt_key")
    if combine == "sum":
        return g.agg(F.min("query").alias("query"), F.sum("calls").cast("bigint").alias("calls"),
                     F.sum("total_exec_time").cast("double").alias("total_exec_time"),
                     F.sum("row_count").cast("bigint").alias("row_count"))
    pick = F.min_by(F.struct("query", "calls", "total_exec_time", "row_count"), F.struct("calls", "query"))
    return g.agg(pick.alias("r")).select(
        *keys, "snapshot_no", "stmt_key", F.col("r.query").alias("query"), F.col("r.calls").cast("bigint").alias("calls"),
        F.col("r.total_exec_time").cast("double").alias("total_exec_time"),
        F.col("r.row_count").cast("bigint").alias("row_count"))


def _latest_two(keyed: DataFrame, keys: list[str]) -> DataFrame:
    snaps = keyed.select(*keys, "snapshot_no").distinct()
    w = Window.partitionBy(*keys).orderBy(F.col("snapshot_no").desc())
    return snaps.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 2)


def stmt_delta(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Latest snapshot against the one before it, per instance.

    New keys (absent before) and keys whose calls increased; unchanged and
    decreased counters (resets) are dropped."""
    k = stmt_keyed(stats, keys)
    pos = _latest_two(k, keys)
    after = k.join(pos.filter("pos = 1").drop("pos"), keys + ["snapshot_no"], "left_semi")
    before = k.join(pos.filter("pos = 2").drop("pos"), keys + ["snapshot_no"], "left_semi").select(
        *keys, "stmt_key", F.col("calls").alias("b_calls"), F.col("total_exec_time").alias("b_time"),
        F.col("row_count").alias("b_rows"))
    j = after.join(before, keys + ["stmt_key"], "left")
    status = F.when(F.col("b_calls").isNull(), F.lit("new")).otherwise(F.lit("changed"))
    out = j.select(*[F.col(c).cast("bigint") if c == "instance_id" else F.col(c) for c in keys],
                   "stmt_key", "query", status.alias("status"),
                   F.coalesce(F.col("calls") - F.col("b_calls"), F.col("calls")).alias("delta_calls"),
                   F.coalesce(F.col("total_exec_time") - F.col("b_time"), F.col("total_exec_time")).alias("delta_time"),
                   F.coalesce(F.col("row_count") - F.col("b_rows"), F.col("row_count")).alias("delta_rows"))
    return out.filter((F.col("status") == "new") | (F.col("delta_calls") > 0))


def stmt_history_delta(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas between every consecutive pair of snapshots (``lag`` per key);
    a counter drop marks ``reset`` and reports the new value as the delta."""
    k = stmt_keyed(stats, keys)
    w = Window.partitionBy(*keys, "stmt_key").orderBy("snapshot_no")
    prev = F.lag("calls").over(w)
    k = k.withColumn("prev_calls", prev).withColumn("prev_snapshot", F.lag("snapshot_no").over(w))
    reset = F.col("calls") < F.col("prev_calls")
    return k.select(*keys, "snapshot_no", "prev_snapshot", "stmt_key",
                    F.when(F.col("prev_calls").isNull() | reset, F.col("calls"))
                     .otherwise(F.col("calls") - F.col("prev_calls")).alias("delta_calls"),
                    reset.alias("reset"))


def stmt_delta_findings(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of one observation window per instance: new statements (count
    and a preview; ``stmt_delta`` has every one with its text), TRUNCATE CASCADE /
    CREATE INDEX CONCURRENTLY among all changed statements, and a summary row."""
    d = stmt_delta(stats, keys).withColumn("__new", F.when(F.col("status") == "new", cut("query", NEW_EXAMPLE_CHARS))).withColumn("__most", -F.col("delta_calls"))
    per = first_k(d, [*keys, "status"], ["__most", "stmt_key"], "__new", NEW_EXAMPLES)
    of = lambda s: F.coalesce(F.max(F.when(F.col("status") == s, F.col("count"))), F.lit(0))
    counts = per.groupBy(*keys).agg(of("new").alias("new_count"), of("changed").alias("active_count"),
                                    F.max(F.when(F.col("status") == "new", F.array_join("kept", "\n"))).alias("new_examples"))
    obs = (d.filter(F.col("status") == "changed").select(*keys, "query", "delta_calls", F.explode(observed_classes(F.col("query"))).alias("kind"))
            .join(counts, keys))
    cols = ["object_name", "severity", "kind", "query", "delta_calls", "examples", "new_count", "active_count"]
    obs_rows = obs.select(*keys, F.lit("(observed)").alias("object_name"), F.lit(WARNING).alias("severity"), "kind",
                          "query", F.col("delta_calls").cast("bigint"),
                          F.lit(None).cast("string").alias("examples"), "new_count", "active_count")
    made = F.array(F.struct(F.lit("(monitor)").alias("object_name"), F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("examples")),
                   F.struct(F.lit("(queries)").alias("object_name"), F.lit("new").alias("kind"), F.col("new_examples").alias("examples")))
    rows = counts.select(*keys, F.inline(F.filter(made, lambda x: (x["kind"] == "summary") | (F.col("new_count") > 0))), "new_count", "active_count").select(
        *keys, "object_name", F.lit(INFO).alias("severity"), "kind", F.lit(None).cast("string").alias("query"),
        F.lit(0).cast("bigint").alias("delta_calls"), "examples", "new_count", "active_count")
    out = obs_rows.unionByName(rows)
    return out.select(*[F.col(c).cast("bigint") if c == "instance_id" else F.col(c) for c in keys],
                      *[F.col(c).cast("bigint") if c.endswith("_count") else F.col(c) for c in cols])


# -- logs ---------------------------------------------------------------------------------
def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def log_assemble(lines: DataFrame, keys: list[str], file_col: str = "file_id", order_col: str = "line_no",
                 text_col: str = "line", block_col: str | None = None,
                 block_lines: int = DEFAULT_BLOCK_LINES, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Assemble multi-line log entries.

    A header line (the server's ``log_line_prefix``, a severity of
    ENTRY_SEVERITIES and a message) starts an entry; tab-indented lines
    continue it; other lines are ignored.  The
    entry number is a running count of headers per file, computed as a
    two-level prefix sum: counts per block of lines, then offsets per file
    over the (few) blocks, then a running count inside each block.  A huge
    file is therefore spread over as many tasks as it has blocks.
    """
    f = [*keys, file_col]
    block = F.col(block_col) if block_col else F.floor(F.col(order_col) / F.lit(block_lines))
    l = (lines.withColumn("__block", block).withColumn("__head", log_line(text_col, prefix))
              .withColumn("__start", F.col("__head").isNotNull().cast("int")))
    per_block = l.groupBy(*f, "__block").agg(F.sum("__start").alias("__n"))
    wb = Window.partitionBy(*f).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("__off", F.coalesce(F.sum("__n").over(wb), F.lit(0))).drop("__n")
    wl = Window.partitionBy(*f, "__block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("__run", F.sum("__start").over(wl)).join(offsets, f + ["__block"])
    l = l.withColumn("entry_no", (F.col("__off") + F.col("__run")).cast("bigint")).filter(F.col("entry_no") > 0)
    is_start = F.col("__start") == 1
    is_cont = ~is_start & F.col(text_col).startswith("\t")
    said = logged_statement(F.col("__head.message"))
    l = l.filter(is_start | is_cont).select(
        *f, "entry_no", order_col, F.col("__head.ts").alias("__ts"),
        F.when(is_start, said["is_statement"]).alias("__is_stmt"),
        F.when(is_start, said["text"]).otherwise(_strip_ws(F.col(text_col))).alias("__piece"))
    e = l.groupBy(*f, "entry_no").agg(
        F.min(order_col).alias(order_col),
        F.max("__ts").alias("ts"),
        F.max("__is_stmt").alias("is_statement"),
        F.array_sort(F.collect_list(F.struct(order_col, "__piece"))).alias("__pieces"))
    # an entry exists only if its header carries a non-empty statement text
    e = e.filter(F.col("ts").isNotNull() & (F.col("__pieces")[0]["__piece"] != ""))
    text = F.array_join(F.transform("__pieces", lambda x: x["__piece"]), " ")
    return e.select(*[F.col(c).cast("bigint") if c == "instance_id" else F.col(c) for c in f],
                    "entry_no", order_col, "ts", "is_statement", text.alias("text"))


def log_classify(entries: DataFrame) -> DataFrame:
    """One row per entry and class (an entry may be in several classes).
    DDL entries that create an index concurrently count as concurrent_index."""
    return entries.select("*", F.explode(statement_classes(F.col("text"))).alias("class"))


def log_findings(entries: DataFrame, keys: list[str], file_col: str = "file_id",
                 order_col: str = "line_no") -> DataFrame:
    """Per instance and class: occurrences and the first examples in log order;
    plus one summary per instance with the number of statements parsed."""
    limits = F.create_map(*[F.lit(x) for kv in LOG_EXAMPLES.items() for x in kv])
    # one row an entry and class, and one an entry for the summary: counted and cut to the first examples in one aggregate
    c = entries.select(*keys, file_col, order_col, "text", "is_statement",
                       F.explode(F.concat(statement_classes(F.col("text")), F.array(F.lit("summary")))).alias("kind"))
    c = c.withColumn("example", F.when(F.col("kind").isin(list(LOG_EXAMPLES)), F.format_string("line %d: %s", F.col(order_col), cut("text", LOG_EXAMPLE_CHARS)))) \
         .withColumn("__n", F.when(F.col("kind") == "summary", F.col("is_statement").cast("int")).otherwise(F.lit(1)))
    g = first_k(c, [*keys, "kind"], [file_col, order_col], "example", max(LOG_EXAMPLES.values()), weight="__n")
    shown = F.slice("kept", F.lit(1), F.coalesce(F.element_at(limits, F.col("kind")), F.lit(0)))
    severity = F.when(F.col("kind").isin([c for c, s in LOG_CLASS_SEVERITY.items() if s == WARNING]), F.lit(WARNING)).otherwise(F.lit(INFO))
    return g.select(*[F.col(k).cast("bigint") if k == "instance_id" else F.col(k) for k in keys], F.lit("(log)").alias("object_name"),
                    severity.alias("severity"), "kind", F.col("count").alias("occurrences"),
                    F.when(F.col("kind").isin(list(LOG_EXAMPLES)), F.array_join(shown, "\n")).alias("examples"))


# -- uniform findings -----------------------------------------------------------------------
_KIND_NAMES = {"truncate_cascade": "TRUNCATE with CASCADE", "concurrent_index": "an index build without a lock", "ddl": "schema changes",
               "advisory_lock": "advisory locks", "temp_table": "temporary tables"}
_KIND_ADVICE = {"truncate_cascade": "Name the dependent tables in the TRUNCATE: a cascade takes effect on the node it runs on only.",
                "concurrent_index": "Build the index on every node by hand.",
                "ddl": "Send schema changes through DDL replication, or run them on all nodes in step."}


def _by_kind(texts: dict[str, str], otherwise: Column | None = None) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("kind"))
    return F.coalesce(out, otherwise) if otherwise is not None else out


# Names of the two observations and their category.
MONITOR_SPECS = {
    "pgstat_observation": CheckSpec(
        "pgstat_observation", "monitor", "monitor", "Statements seen between two snapshots", lambda cat: stmt_delta_findings(cat["stat_statements"], cat.keys),
        ("stat_statements",),
        title=lambda: F.when(F.col("kind") == "summary", F.format_string("%d statement(s) ran between the snapshots, %d of them new", F.col("active_count") + F.col("new_count"), F.col("new_count")))
        .when(F.col("kind") == "new", F.format_string("%d new statement(s)", F.col("new_count")))
        .otherwise(F.format_string("Seen %d time(s): %s", F.col("delta_calls"), _by_kind(_KIND_NAMES))),
        detail=lambda: F.coalesce(F.col("query"), F.col("examples"), F.format_string("Active: %d, new: %d", F.col("active_count"), F.col("new_count"))),
        remediation=lambda: _by_kind(_KIND_ADVICE)),
    "log_analysis": CheckSpec(
        "log_analysis", "monitor", "monitor", "Statements found in the server log",
        lambda cat: log_findings(log_assemble(cat["log_lines"], cat.keys), cat.keys), ("log_lines",),
        title=lambda: F.when(F.col("kind") == "summary", F.format_string("%d statement(s) in the log", F.col("occurrences")))
        .otherwise(F.format_string("The log holds %s (%d)", _by_kind(_KIND_NAMES), F.col("occurrences"))),
        detail=lambda: F.coalesce(F.col("examples"), _by_kind({"advisory_lock": "A lock taken on one node is not known to the others.",
                                                                "temp_table": "Temporary tables live in one session and are not replicated."}, F.lit("All entries of the log"))),
        remediation=lambda: _by_kind(_KIND_ADVICE)),
}


def monitor_findings(cat) -> DataFrame:
    """Findings of the statement window and of the log in the uniform shape, ready for the report rollups; an input that is missing gives none."""
    parts = [to_findings(s, s.fn(cat), cat.keys) for s in MONITOR_SPECS.values() if all(cat.has(t) for t in s.needs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
