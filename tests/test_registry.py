from collections import Counter

from fleetlint.checks.registry import REGISTRY, select_checks


def test_57_checks_by_category():
    select_checks()
    assert len(REGISTRY) == 57
    assert Counter(s.category for s in REGISTRY.values()) == {
        "schema": 22, "replication": 12, "config": 8, "extensions": 5,
        "sql_patterns": 5, "functions": 3, "sequences": 2}


def test_modes_add_up():
    both = sum(1 for s in REGISTRY.values() if s.mode == "both")
    assert len(select_checks("scan")) + len(select_checks("audit")) - both == 57
    assert both == 1


def test_include_only_beats_exclude():
    got = select_checks(None, exclude=["primary_keys"], include_only=["primary_keys", "wal_level"])
    assert [s.name for s in got] == ["primary_keys", "wal_level"]
    assert len(select_checks(None, exclude=["primary_keys", "wal_level"])) == 55


def test_order_is_category_then_name():
    names = [(s.category, s.name) for s in select_checks()]
    cats = ["schema", "replication", "config", "extensions", "sql_patterns", "functions", "sequences"]
    assert names == sorted(names, key=lambda x: (cats.index(x[0]), x[1]))
