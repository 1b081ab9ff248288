"""A check that fails must not read as one that found nothing."""

import pytest
from pyspark.sql import functions as F

from fleetlint.plans import analyze as AZ
from fleetlint.plans import report
from fleetlint.plans.queries import QUERIES
from fleetlint.sources.catalog import Catalog


def _fleet(spark, broken: bool) -> Catalog:
    """Two instances with settings; broken: the settings fail in the task that reads them."""
    rows = spark.createDataFrame([(1, "wal_level", "logical"), (2, "wal_level", "replica")], "instance_id long, name string, setting string")
    if broken:
        rows = rows.withColumn("setting", F.raise_error(F.lit("no such page")).cast("string"))
    instances = spark.createDataFrame([(1, "a"), (2, "b")], "instance_id long, cluster_id string")
    return Catalog(spark, {"instances": lambda: instances, "settings": lambda: rows})


@pytest.mark.parametrize("name", ["verdict", "severity_counts"])
def test_rollups_need_every_check(spark, monkeypatch, name):
    monkeypatch.setattr(Catalog, "from_fixtures", lambda spark, sf_dir: _fleet(spark, True))
    with pytest.raises(report.ChecksFailed, match="wal_level: .*no such page") as e:
        QUERIES[name](spark, "").collect()
    assert "wal_level" in e.value.errors
    monkeypatch.setattr(Catalog, "from_fixtures", lambda spark, sf_dir: _fleet(spark, False))
    got = {r.instance_id: r.critical for r in QUERIES[name](spark, "").collect()}
    assert got[2] == got[1] + 1      # only the second has a wal_level that is not logical


def _dump(spark, broken: bool) -> Catalog:
    """What one dump holds: an unlogged table and an enum; broken: the enum's labels fail in the task that reads them."""
    def one(columns: str, *row):
        df = spark.createDataFrame([(1, "f", *row)], f"instance_id long, file_id string, {columns}")
        return lambda: df

    enum = one("typnamespace long, typname string, enumlabel string, enumsortorder long", 10, "mood", "sad", 1)
    loaders = {"instances": one("cluster_id string", "a"), "cat_namespace": one("oid long, nspname string", 10, "public"),
               "cat_class": one("oid long, relnamespace long, relname string, relkind string, relpersistence string", 20, 10, "t", "r", "u"),
               "cat_enum": (lambda: enum().withColumn("enumlabel", F.raise_error(F.lit("no such page")).cast("string"))) if broken else enum}
    cat = Catalog(spark, loaders, keys=["instance_id", "file_id"])
    cat.source = "dump"
    return cat


def test_offline_status_tells_failed_checks(spark):
    got, sound = ({r.check_name: r for r in AZ.analyze_check_status(_dump(spark, broken)).collect()} for broken in (True, False))
    assert got["enum_types"].status == "error" and "no such page" in got["enum_types"].error
    assert sound["enum_types"].status == "failed" and sound["enum_types"].finding_count == 1
    assert len(got) == len(sound) == 57 and got["unlogged_tables"].status == "failed"
    assert {n: r for n, r in got.items() if n != "enum_types"} == {n: r for n, r in sound.items() if n != "enum_types"}


def test_offline_findings_need_every_check(spark):
    with pytest.raises(report.ChecksFailed, match="enum_types: .*no such page") as e:
        AZ.analyze_findings(_dump(spark, True)).collect()
    assert set(e.value.errors) == {"enum_types"}
    assert {(r.check_name, r.object_name) for r in AZ.analyze_findings(_dump(spark, False)).collect()} >= {("enum_types", "public.mood"), ("unlogged_tables", "public.t")}
