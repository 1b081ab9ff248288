"""Text fixtures (FIXTURES.md section 3): logs, statements, dumps."""
import pytest
from pyspark.sql import functions as F

from fleetlint.checks.sql_patterns import STATEMENT_PATTERNS
from fleetlint.operators.relops import regex_classes
from fleetlint.plans import activity as A
from fleetlint.plans import dump as D

LOG = [
    "2024-01-01 10:00:00.000 UTC [1] LOG:  statement: TRUNCATE TABLE a",
    "\tCASCADE",
    "\tWHERE x = 1",
    "noise line without header",
    "2024-01-01 10:00:01 UTC [1] ERROR:  relation t does not exist CREATE TABLE t (a int)",
    "2024-01-01 10:00:02 UTC [1] LOG:  execute s1: SELECT pg_advisory_lock(1)",
    "2024-01-01 10:00:03 UTC [1] LOG:  ",
    "\tlost continuation",
    "2024-01-01 10:00:04 UTC [1] LOG:  statement: CREATE INDEX CONCURRENTLY i ON t (c)",
]


def _lines(spark, lines, block=None):
    rows = [(0, 7, i + 1, l) for i, l in enumerate(lines)]
    return spark.createDataFrame(rows, "instance_id long, file_id long, line_no long, line string")


def test_log_assembly_and_classes(spark):
    e = A.log_assemble(_lines(spark, LOG), ["instance_id"], block_lines=3)
    got = {r.line_no: (r.text, r.is_statement) for r in e.collect()}
    assert got == {
        1: ("TRUNCATE TABLE a CASCADE WHERE x = 1", True),
        5: ("relation t does not exist CREATE TABLE t (a int)", False),
        6: ("SELECT pg_advisory_lock(1)", True),
        9: ("CREATE INDEX CONCURRENTLY i ON t (c)", True),
    }
    cls = {(r.line_no, r["class"]) for r in A.log_classify(e).collect()}
    assert cls == {(1, "truncate_cascade"), (5, "ddl"), (6, "advisory_lock"), (9, "concurrent_index")}
    f = {r.kind: r.occurrences for r in A.log_findings(e, ["instance_id"]).collect()}
    assert f == {"truncate_cascade": 1, "ddl": 1, "advisory_lock": 1, "concurrent_index": 1, "summary": 3}


def test_block_size_does_not_change_entries(spark):
    df = _lines(spark, LOG * 5)
    a = sorted(map(tuple, A.log_assemble(df, ["instance_id"], block_lines=2).collect()))
    b = sorted(map(tuple, A.log_assemble(df, ["instance_id"], block_lines=1000).collect()))
    assert a == b and len(a) == 20


STATEMENTS = {
    "TRUNCATE TABLE t CASCADE": {"truncate_cascade"},
    "truncate table t\ncascade": {"truncate_cascade"},
    "TRUNCATE t RESTART IDENTITY": {"truncate_restart"},
    "create index\nconcurrently i on t (c)": {"concurrent_index", "ddl"},
    "CREATE INDEX CONCURRENTLY i ON t (c)": {"concurrent_index", "ddl"},
    "ALTER TABLE t ADD c int": {"ddl"},
    "select pg_try_advisory_lock(1)": {"advisory_lock"},
    "create temporary\ntable x (a int)": {"temp_table"},
    "SELECT 1": set(),
}


def test_statement_classes(spark):
    df = spark.createDataFrame([(q,) for q in STATEMENTS], "query string")
    got = {r.query: set(r.c) for r in df.select("query", regex_classes("query", STATEMENT_PATTERNS).alias("c")).collect()}
    assert got == STATEMENTS


DUMP = """--
-- PostgreSQL database dump
-- Dumped from database version 16.2
--
SET search_path = app, pg_catalog;
CREATE EXTENSION IF NOT EXISTS hstore WITH SCHEMA public;
CREATE TYPE public.mood AS ENUM (
    'sad',
    'ok',
    'happy'
);
CREATE FUNCTION app.f() RETURNS trigger
    LANGUAGE plpgsql
    AS $$
begin
  insert into t values (1);

  return new;
end;
$$;
CREATE UNLOGGED TABLE "Orders" (
    id bigint NOT NULL,
    amount numeric(10,2) DEFAULT 0 NOT NULL,
    note text NOT NULL DEFAULT 'a,b',
    total numeric GENERATED ALWAYS AS (amount * 2) STORED,
    seq_id integer GENERATED BY DEFAULT AS IDENTITY,
    CONSTRAINT orders_amount_check CHECK (amount > 0)
);
CREATE TABLE public.child (
    id bigint
) INHERITS (public.parent);
CREATE TABLE public.events (
    id bigint,
    ts timestamp
) PARTITION BY RANGE (ts);
ALTER TABLE ONLY public.child ALTER COLUMN id SET DEFAULT 1;
ALTER TABLE ONLY public.child ALTER COLUMN id SET DEFAULT nextval('s');
ALTER TABLE ONLY public.child ADD CONSTRAINT child_fk FOREIGN KEY (id) REFERENCES public.parent(id) ON DELETE CASCADE DEFERRABLE INITIALLY DEFERRED;
CREATE SEQUENCE public.s
    AS integer
    START WITH 1
    INCREMENT BY 1
    NO MINVALUE
    MAXVALUE 2147483647
    CACHE 1;
ALTER SEQUENCE public.s OWNED BY public.child.id;
CREATE UNIQUE INDEX ix_u ON public.child USING hash (id);
CREATE RULE r1 AS ON INSERT TO public.child DO INSTEAD NOTHING;
CREATE TABLE pg_catalog.hidden (a int);"""


def _dump(spark, text=DUMP, file_id=1):
    rows = [(0, file_id, i + 1, l) for i, l in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "instance_id long, file_id long, line_no long, line string")


def test_dump_statements(spark):
    st = D.dump_statements(_dump(spark), ["instance_id"], block_lines=4)
    rows = st.orderBy("stmt_no").collect()
    kinds = [r.kind for r in rows]
    assert kinds == ["other", "extension", "enum", "other", "table", "table", "table", "default", "default",
                     "constraint", "sequence", "owned_by", "index", "rule", "table"]
    assert {r.pg_version for r in rows} == {"16.2"}
    fn = rows[3].text
    assert fn.startswith("CREATE FUNCTION") and fn.endswith("$$;") and "end;" in fn and "\n\n" not in fn
    assert rows[4].search_path == "app"


def test_dump_facts(spark):
    st = D.dump_statements(_dump(spark), ["instance_id"]).cache()
    k = ["instance_id"]
    t = {r.table_name: r for r in D.dump_tables(st, k).collect()}
    assert set(t) == {"Orders", "child", "events"}
    assert t["Orders"].schema_name == "app" and t["Orders"].unlogged
    assert t["child"].inherits == "public.parent" and t["events"].partition_by == "RANGE (ts)"
    cols = {(r.table_name, r.column_name): r for r in D.dump_columns(st, k).collect()}
    o = {c: cols[("Orders", c)] for c in ("id", "amount", "note", "total", "seq_id")}
    assert [o[c].attnum for c in ("id", "amount", "note", "total", "seq_id")] == [1, 2, 3, 4, 5]
    assert o["amount"].data_type == "numeric(10,2)" and o["amount"].default_expr == "0" and o["amount"].not_null
    assert o["note"].default_expr == "'a,b'" and o["note"].not_null
    assert o["total"].generated == "s" and o["total"].generation_expr == "amount * 2"
    assert o["seq_id"].identity == "d" and o["seq_id"].data_type == "integer"
    assert cols[("child", "id")].default_expr == "nextval('s')"
    con = {r.constraint_name: r for r in D.dump_constraints(st, k).collect()}
    assert con["orders_amount_check"].contype == "c"
    fk = con["child_fk"]
    assert (fk.contype, fk.columns, fk.ref_table, fk.ref_columns, fk.on_delete, fk.on_update, fk.deferrable,
            fk.deferred) == ("f", "id", "public.parent", "id", "c", "a", True, True)
    seq = D.dump_sequences(st, k).collect()[0]
    assert (seq.sequence_name, seq.data_type, seq.start_value, seq.increment, seq.min_value, seq.max_value,
            seq.is_cycle, seq.owner_table, seq.owner_column) == ("s", "integer", 1, 1, None, 2147483647, False,
                                                                 "public.child", "id")
    ix = D.dump_indexes(st, k).collect()[0]
    assert (ix.index_name, ix.is_unique, ix.method, ix.columns) == ("ix_u", True, "hash", "id")
    ext = D.dump_extensions(st, k).collect()[0]
    assert (ext.extension_name, ext.schema_name) == ("hstore", "public")
    en = D.dump_enums(st, k).collect()[0]
    assert (en.type_name, en.label_count, en.labels) == ("mood", 3, "sad,ok,happy")
    ru = D.dump_rules(st, k).collect()[0]
    assert (ru.rule_name, ru.event, ru.table_name, ru.is_instead) == ("r1", "INSERT", "child", True)


def test_nested_dollar_tags_use_exact_fallback(spark):
    text = "\n".join([
        "CREATE FUNCTION a() RETURNS int AS $outer$",
        "begin",
        "  execute $inner$ select 1; $inner$;",
        "  perform $x$;",
        "  return 1;",
        "end;",
        "$outer$;",
        "CREATE TABLE public.t (a int);",
    ])
    st = D.dump_statements(_dump(spark, text, 2), ["instance_id"]).orderBy("stmt_no").collect()
    assert [r.kind for r in st] == ["other", "table"]
    assert st[0].last_line == 7


def test_analyze_dump_runs_offline_checks(spark):
    from fleetlint.plans import analyze as AZ
    cat = AZ.catalog_from_dump(spark, _dump(spark))
    f = AZ.analyze_findings(cat)
    got = {(r.check_name, r.severity, r.object_name) for r in f.collect()}
    expected = {
        ("primary_keys", "WARNING", "app.Orders"), ("primary_keys", "WARNING", "public.child"),
        ("unlogged_tables", "WARNING", "app.Orders"),
        ("numeric_columns", "CONSIDER", "app.Orders.amount"), ("numeric_columns", "WARNING", "app.Orders.total"),
        ("generated_columns", "CONSIDER", "app.Orders.total"),
        ("foreign_keys", "WARNING", "public.child"), ("foreign_keys", "CONSIDER", "(database)"),
        ("sequence_audit", "WARNING", "public.s"), ("sequence_data_types", "WARNING", "public.s"),
        ("enum_types", "CONSIDER", "public.mood"), ("rules", "WARNING", "public.child.r1"),
        ("installed_extensions", "INFO", "hstore"), ("installed_extensions", "CONSIDER", "(extensions)"),
        ("pg_version", "INFO", "pg_version"),
    }
    assert expected <= got, expected - got
    assert not any(c == "missing_fk_indexes" for c, _, _ in got)   # the unique index covers child(id)
    nover = AZ.catalog_from_dump(spark, _dump(spark, DUMP.replace("-- Dumped from database version 16.2\n", ""), 3))
    pv = [(r.severity, r.object_name) for r in AZ.analyze_findings(nover).collect() if r.check_name == "pg_version"]
    assert pv == [("WARNING", "pg_version")]
    st = {r.check_name: r.status for r in AZ.analyze_check_status(cat, f).collect()}
    assert len(st) == 57 and sum(1 for s in st.values() if s == "skipped") == 57 - 19


EXTRA_DUMP = """SET search_path = '', pg_catalog;
CREATE SEQUENCE public.c AS smallint START WITH 5 INCREMENT BY 2 MINVALUE 5 MAXVALUE 100 CYCLE;
CREATE TABLE public.w (
    id integer NOT NULL,
    label text
);
ALTER TABLE public.w ALTER COLUMN id ADD GENERATED ALWAYS AS IDENTITY (
    SEQUENCE NAME public.w_id_seq
);
ALTER TABLE ONLY public.w ALTER COLUMN label SET DEFAULT 'x'::text;
CREATE TYPE public.q AS ENUM (
    'it''s',
    'b'
);
CREATE EXTENSION snowflake;
CREATE RULE r2 AS ON UPDATE TO public.w DO ALSO NOTIFY w;"""


@pytest.mark.parametrize("text", [DUMP, EXTRA_DUMP], ids=["rich", "extra"])
def test_dump_oracles_agree_on_rich_fixture(spark, text):
    """The DuckDB oracles and the Spark jobs agree on the hand-written dumps."""
    import duckdb
    import pandas as pd

    from __spark_entry__ import queries  # noqa: F401  (registers the dump queries)
    from fleetlint.oracles.dump import SQL
    from helpers import canon

    lines = _dump(spark, text)
    con = duckdb.connect()
    con.register("dump_lines_df", lines.toPandas())
    con.execute("create table dump_lines as select * from dump_lines_df")
    st = D.dump_statements(lines, ["instance_id"])
    spark_out = {"dump_statements": st, "dump_tables": D.dump_tables(st, ["instance_id"]),
                 "dump_columns": D.dump_columns(st, ["instance_id"]),
                 "dump_constraints": D.dump_constraints(st, ["instance_id"]),
                 "dump_indexes": D.dump_indexes(st, ["instance_id"]),
                 "dump_sequences": D.dump_sequences(st, ["instance_id"]),
                 "dump_defaults_identity": D.dump_defaults_identity(st, ["instance_id"]),
                 "dump_extensions": D.dump_extensions(st, ["instance_id"]),
                 "dump_enums": D.dump_enums(st, ["instance_id"]),
                 "dump_rules": D.dump_rules(st, ["instance_id"])}
    for name, df in spark_out.items():
        got = canon(df.toPandas())
        want = canon(con.execute(SQL[name]).df())
        assert got == want, name
        if text is DUMP or name != "dump_constraints" and name != "dump_indexes":
            assert len(got[1]) > 0, name
