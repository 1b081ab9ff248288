"""Golden catalog (FIXTURES.md section 1): a small hand-written catalog that
describes the database of a lending library, with the findings expected per check."""
import pytest

from fleetlint.checks.registry import get
from fleetlint.sources.catalog import Catalog

PUB, CAT = 2200, 11
T = {  # name -> (oid, relkind, persistence)
    "visits": (101, "r", "p"), "scan_buffer": (102, "r", "u"), "media": (103, "r", "p"),
    "atlas": (104, "r", "p"), "room_bookings": (105, "r", "p"), "loans": (106, "p", "p"),
    "loans_north": (107, "r", "p"), "loans_south": (108, "r", "p"), "loans_mobile": (112, "r", "p"), "desk_journal": (109, "r", "p"),
    "withdrawn": (110, "r", "p"), "gate_counts": (111, "r", "p"),
    "shelves": (120, "r", "p"), "readers": (121, "r", "p"), "seats": (122, "r", "p"),
    "cards": (123, "r", "p"), "branches": (124, "r", "p"), "branch_hours": (125, "r", "p"),
    "publishers": (126, "r", "p"), "imprints": (127, "r", "p"), "fines": (128, "r", "p"),
    "cover_scans": (129, "r", "p"), "budgets": (130, "r", "p"), "call_numbers": (131, "r", "p"),
    "invoices": (132, "r", "p"), "returns_box": (133, "r", "p"), "reservations": (134, "r", "p"),
    "books": (140, "r", "p"), "subjects": (141, "r", "p"), "vendors": (142, "r", "p"),
    "purchases": (143, "r", "p"), "donors": (144, "r", "p"), "staff": (145, "r", "p"),
    "purchase_lines": (146, "r", "p"), "stock_report": (150, "m", "p"), "open_titles": (151, "v", "p"),
}
NO_PK = {"visits", "scan_buffer", "media", "atlas", "room_bookings", "loans_north",
         "loans_south", "loans_mobile", "desk_journal", "withdrawn", "gate_counts", "loans",
         "stock_report", "open_titles"}
# (table, attnum, name, type, notnull, generated, identity, default)
COLS = [("shelves", 1, "id", "integer", True, "", "", "nextval('shelf_numbers'::regclass)"),
        ("readers", 1, "id", "integer", True, "", "a", None),
        ("budgets", 2, "copy_count", "integer", False, "", "", None),
        ("budgets", 3, "spent_sum", "numeric(12,2)", False, "", "", None),
        ("budgets", 4, "fund_balance", "numeric", True, "", "", None),
        ("invoices", 2, "net", "numeric", True, "", "", None),
        ("invoices", 3, "total", "numeric", False, "s", "", "(net + tax)"),
        ("returns_box", 2, "dropped_at", "timestamp with time zone", False, "", "", "now()"),
        ("returns_box", 3, "lottery", "double precision", False, "", "", "random()"),
        ("purchase_lines", 1, "purchase", "integer", True, "", "", None),
        ("purchase_lines", 2, "book", "integer", True, "", "", None),
        ("purchase_lines", 3, "rebate_total", "numeric", False, "", "", None),
        ("purchase_lines", 4, "quantity", "integer", True, "", "", None),
        ("books", 2, "vendor", "integer", False, "", "", None),
        ("books", 3, "subject", "integer", False, "", "", None),
        ("purchases", 2, "donor", "integer", False, "", "", None),
        ("purchases", 3, "clerk", "integer", False, "", "", None),
        ("imprints", 2, "owner", "integer", False, "", "", None),
        ("branch_hours", 2, "owner", "integer", False, "", "", None),
        ("cards", 2, "barcode", "text", False, "", "", None),
        ("cover_scans", 2, "scan", "oid", False, "", "", None)]
FKS = [("books", [2], "vendors", "a"), ("books", [3], "subjects", "a"),
       ("purchases", [2], "donors", "a"), ("purchases", [3], "staff", "a"),
       ("purchase_lines", [1], "purchases", "a"), ("purchase_lines", [2], "books", "a"),
       ("imprints", [2], "publishers", "a"), ("branch_hours", [2], "branches", "c")]


@pytest.fixture(scope="module")
def golden(spark):
    fx = Catalog.from_fixtures(spark, "/root/testdata/sf0.001")

    def df(view, rows):
        return spark.createDataFrame(rows, fx[view].schema)

    oid = {n: v[0] for n, v in T.items()}
    cons, idx, k = [], [], 1000
    for n in T:
        if n in NO_PK:
            continue
        key = [1, 2] if n == "purchase_lines" else [1]
        dfr = n == "seats"
        cons.append((0, k, oid[n], f"{n}_pkey", "p", key, 0, dfr, dfr, "a", "a")); k += 1
        idx.append((0, oid[n], f"{n}_pkey", key, True))
    cons.append((0, k, oid["cards"], "cards_barcode_key", "u", [2], 0, True, False, "a", "a"))
    idx.append((0, oid["cards"], "cards_barcode_key", [2], True)); k += 1
    cons.append((0, k, oid["room_bookings"], "room_bookings_excl", "x", [1], 0, False, False, "a", "a"))
    k += 1
    for t, key, ref, act in FKS:
        cons.append((0, k, oid[t], f"{t}_fk{k}", "f", key, oid[ref], False, False, act, "a")); k += 1
    idx += [(0, oid["call_numbers"], f"call_numbers_u{i}", [i + 1], True) for i in range(1, 3)]
    tables = {
        "instances": df("instances", [(0, "cluster_0")]),
        "cat_namespace": df("cat_namespace", [(0, PUB, "public"), (0, CAT, "pg_catalog")]),
        "cat_class": df("cat_class", [(0, o, PUB, n, kind, pers, n == "fines", False, 0)
                                      for n, (o, kind, pers) in T.items()] +
                        [(0, 9000, CAT, "pg_class", "r", "p", False, False, 0)]),
        "cat_attribute": df("cat_attribute",
                            [(0, oid[t], a, n, ty, nn, g, i, d) for t, a, n, ty, nn, g, i, d in COLS] +
                            [(0, o, 1, "id", "bigint", True, "", "", None) for n, (o, _, _) in T.items()
                             if n not in {c[0] for c in COLS if c[1] == 1}]),
        "cat_constraint": df("cat_constraint", cons),
        "cat_index": df("cat_index", idx),
        "cat_table_stats": df("cat_table_stats", [(0, oid["visits"], 40, 7, 3),
                                                  (0, oid["gate_counts"], 900, 0, 0)]),
        "cat_inherits": df("cat_inherits", [(0, oid["atlas"], oid["media"]),
                                            (0, oid["loans_north"], oid["loans"]),
                                            (0, oid["loans_south"], oid["loans"]), (0, oid["loans_mobile"], oid["loans"])]),
        "cat_partitioned": df("cat_partitioned", [(0, oid["loans"], "l")]),
        "cat_policy": df("cat_policy", [(0, 7001, oid["fines"])]),
        "cat_rewrite": df("cat_rewrite", [(0, oid["reservations"], "keep_reserved", "3", True),
                                          (0, oid["reservations"], "note_reserved", "2", False),
                                          (0, oid["open_titles"], "_RETURN", "1", True)]),
        "cat_enum": df("cat_enum", [(0, PUB, "item_state", lbl, i) for i, lbl in
                                    enumerate(["ordered", "on shelf", "lent", "lost"], 1)]),
        "cat_sequence": df("cat_sequence", [
            (0, PUB, "shelf_numbers", "integer", 1, 1, 2147483647, False, oid["shelves"], 1),
            (0, PUB, "reader_numbers", "integer", 1, 1, 2147483647, False, oid["readers"], 1),
            (0, PUB, "locker_numbers", "smallint", 1, 1, 32767, False, None, None),
            (0, PUB, "barcodes", "bigint", 1, 1, 9223372036854775807, False, None, None)]),
        "cat_proc": df("cat_proc", [
            (0, 501, PUB, "call_desk", "f", "plpgsql", "v", "BEGIN PERFORM pg_notify('desk', 'bell ' || NEW.id); RETURN NULL; END;"),
            (0, 502, PUB, "close_loan", "f", "plpgsql", "v", "BEGIN INSERT INTO desk_journal VALUES (loan); DELETE FROM loans WHERE id = loan; END;"),
            (0, 503, PUB, "weekly_count", "f", "plpgsql", "v", "BEGIN CREATE TEMP TABLE week (day date, n int); DROP TABLE week; END;"),
            (0, 504, PUB, "shelf_label", "f", "sql", "i", "SELECT upper($1)")]),
        "cat_trigger": df("cat_trigger", [(0, oid["desk_journal"], "ring_desk", 5, "A", False, 501)]),
        "cat_event_trigger": df("cat_event_trigger", [(0, "watch_schema", "ddl_command_start", "O")]),
        "cat_tablespace": df("cat_tablespace", [(0, 1663, "pg_default")]),
        "cat_largeobject": df("cat_largeobject", [(0, 16999)]),
    }
    empty_stats = spark.createDataFrame([], fx["stat_statements"].schema)
    tables["stat_statements"] = empty_stats
    return Catalog(spark, {n: (lambda d: (lambda: d))(d) for n, d in tables.items()})


def found(cat, name):
    return sorted((r.severity, r.object_name) for r in get(name).fn(cat).collect())


def test_primary_keys(golden):
    assert found(golden, "primary_keys") == sorted(("WARNING", f"public.{n}") for n in NO_PK
                                                   if T[n][1] == "r")


def test_no_pk_activity(golden):
    assert found(golden, "tables_update_delete_no_pk") == [("CRITICAL", "public.visits"),
                                                           ("INFO", "public.gate_counts")]


def test_sequence_pks_unlogged_inheritance(golden):
    assert found(golden, "sequence_pks") == [("CRITICAL", "public.readers"),
                                             ("CRITICAL", "public.shelves")]
    assert found(golden, "unlogged_tables") == [("WARNING", "public.scan_buffer")]
    assert found(golden, "inheritance") == [("WARNING", "public.atlas")]


def test_constraints(golden):
    d = {r.object_name: (r.severity, r.initially) for r in get("deferrable_constraints").fn(golden).collect()}
    assert d == {"public.seats.seats_pkey": ("CRITICAL", "DEFERRED"),
                 "public.cards.cards_barcode_key": ("WARNING", "IMMEDIATE")}
    assert [r.severity for r in get("exclusion_constraints").fn(golden).collect()] == ["WARNING"]
    fk = {r.object_name: r for r in get("foreign_keys").fn(golden).collect()}
    assert fk["(database)"].fk_count == 8 and fk["(database)"].cascade_count == 1
    assert fk["public.branch_hours"].severity == "WARNING" and len(fk) == 2


def test_missing_fk_indexes(golden):
    got = sorted(r.object_name + ":" + r.fk_columns for r in get("missing_fk_indexes").fn(golden).collect())
    assert got == sorted(["public.books:vendor", "public.books:subject",
                          "public.purchases:donor", "public.purchases:clerk",
                          "public.purchase_lines:book", "public.imprints:owner",
                          "public.branch_hours:owner"])


def test_columns(golden):
    assert found(golden, "numeric_columns") == sorted([
        ("WARNING", "public.budgets.copy_count"), ("WARNING", "public.budgets.spent_sum"),
        ("WARNING", "public.invoices.total"), ("WARNING", "public.purchase_lines.rebate_total"),
        ("CONSIDER", "public.budgets.fund_balance"), ("CONSIDER", "public.purchase_lines.quantity")])
    assert found(golden, "generated_columns") == [("CONSIDER", "public.invoices.total")]
    assert found(golden, "column_defaults") == [("CONSIDER", "public.returns_box.dropped_at"),
                                                ("CONSIDER", "public.returns_box.lottery")]
    assert ("WARNING", "public.cover_scans.scan") in found(golden, "large_objects")
    assert ("WARNING", "pg_largeobject") in found(golden, "large_objects")


def test_tables_misc(golden):
    mu = {r.object_name: r.unique_index_count for r in get("multiple_unique_indexes").fn(golden).collect()}
    assert mu == {"public.call_numbers": 3, "public.cards": 2}
    p = get("partitioned_tables").fn(golden).collect()
    assert [(r.object_name, r.strategy, r.partition_count) for r in p] == [("public.loans", "LIST", 3)]
    r = get("row_level_security").fn(golden).collect()
    assert [(x.object_name, x.policy_count, x.rls_forced) for x in r] == [("public.fines", 1, False)]
    assert found(golden, "rules") == [("CONSIDER", "public.reservations.note_reserved"),
                                      ("WARNING", "public.reservations.keep_reserved")]
    e = get("enum_types").fn(golden).collect()
    assert [(x.object_name, x.label_count, x.labels) for x in e] == [("public.item_state", 4, "ordered,on shelf,lent,lost")]


def test_sequences(golden):
    assert len(found(golden, "sequence_audit")) == 4
    assert found(golden, "sequence_data_types") == [("WARNING", "public.locker_numbers"), ("WARNING", "public.reader_numbers"),
                                                    ("WARNING", "public.shelf_numbers")]


def test_functions(golden):
    assert found(golden, "notify_listen") == [("WARNING", "public.call_desk")]
    assert found(golden, "temp_tables") == [("CONSIDER", "public.weekly_count")]
    sp = {r.object_name: r.writes for r in get("stored_procedures").fn(golden).collect()}
    assert sp == {"public.call_desk": "PERFORM", "public.close_loan": "INSERT,DELETE",
                  "public.weekly_count": "CREATE,DROP", "(functions)": None}
    t = get("trigger_functions").fn(golden).collect()
    assert [(x.object_name, x.severity, x.timing, x.event, x.enabled) for x in t] == [
        ("public.desk_journal.ring_desk", "WARNING", "AFTER", "INSERT", "A")]
    v = {(r.kind, r.object_name): (r.view_count, r.materialized_count) for r in get("views_audit").fn(golden).collect()}
    assert v == {("materialized", "public.stock_report"): (2, 1), ("total", "(views)"): (2, 1)}
    assert found(golden, "event_triggers") == [("INFO", "watch_schema")]
