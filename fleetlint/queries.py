"""The named queries exposed through ``__spark_entry__`` and the bench.

Each query takes ``(spark, sf_dir)``, builds the fixture catalog over the
driver tables in ``sf_dir`` and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .checks import registry
from .sources.catalog import Catalog

QueryFn = Callable[[SparkSession, str], DataFrame]


def _check_query(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registry.facts(name, Catalog.from_fixtures(spark, sf_dir))
    run.__name__ = name
    run.__doc__ = registry.get(name).description
    return run


def all_queries() -> dict[str, QueryFn]:
    registry._load_all()
    out: dict[str, QueryFn] = {}
    for spec in registry.select_checks():
        out[spec.name] = _check_query(spec.name)
    from .plans import queries as plan_queries
    out.update(plan_queries.QUERIES)
    from .plans import io_queries
    out.update(io_queries.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    from .oracles import build
    from .oracles import checks_sql
    texts: dict[str, str] = {}
    texts.update(checks_sql.SQL)
    from .plans import queries as plan_queries
    texts.update(plan_queries.ORACLES)
    from .plans import io_queries
    texts.update(io_queries.ORACLES)
    flat = plan_queries.NO_INSTANCE_COLUMN
    return {k: build(v, bigint_instance=(k not in flat and "instance_id" in v)) for k, v in texts.items()}
