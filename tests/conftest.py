import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from fleetlint.session import get_spark
    s = get_spark("local[8]", 8)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from fleetlint.sources.catalog import BASE_TABLES

    def connect(sf_dir):
        con = duckdb.connect()
        for t in BASE_TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        return con
    return connect
