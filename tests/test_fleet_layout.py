"""src_catalog_snapshot: a fleet layout with two snapshots, read with
(instance_id, snapshot_ts) as scope keys, gives per snapshot exactly the
findings of the single-snapshot catalog."""
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlint.checks.registry import get
from fleetlint.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
SNAPS = [("2026-11-30", "2026-11-30 06:00:00"), ("2026-12-01", "2026-12-01 06:00:00")]


@pytest.fixture(scope="module")
def fleet(spark):
    base = Catalog.from_fixtures(spark, SF)
    root = tempfile.mkdtemp(prefix="fleetlint-fleet-")
    for t in base.available():
        parts = [base[t].withColumn("snapshot_ts", F.to_timestamp(F.lit(ts))).withColumn("snapshot_date", F.lit(d))
                 for d, ts in SNAPS]
        parts[0].unionByName(parts[1]).write.mode("overwrite").partitionBy("snapshot_date").parquet(f"{root}/{t}")
    return base, root


@pytest.mark.parametrize("name", ["primary_keys", "foreign_keys", "missing_fk_indexes", "enum_types",
                                  "conflict_log", "spock_gucs", "sequence_audit", "hba_config",
                                  "truncate_cascade", "views_audit"])
def test_two_snapshots_equal_single(spark, fleet, name):
    base, root = fleet
    cat = Catalog.from_path(spark, root)
    got = get(name).fn(cat)
    assert "snapshot_ts" in got.columns
    want = sorted(tuple(r) for r in get(name).fn(base).collect())
    for _, ts in SNAPS:
        one = got.filter(F.col("snapshot_ts") == F.to_timestamp(F.lit(ts))).drop("snapshot_ts", "snapshot_date")
        assert sorted(tuple(r) for r in one.select(*get(name).fn(base).columns).collect()) == want


def test_snapshot_pruning(spark, fleet):
    _, root = fleet
    cat = Catalog.from_path(spark, root, snapshot_date="2026-12-01")
    plan = cat["cat_class"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "2026-12-01" in plan
    assert cat["cat_class"].select("snapshot_ts").distinct().count() == 1
