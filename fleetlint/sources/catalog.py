"""Catalog snapshots of a fleet, as lazily loaded Spark tables (src_catalog_snapshot).

Every table carries the scope keys (``instance_id`` and, for a multi-snapshot
layout, ``snapshot_ts``); checks join and group on ``catalog.keys + [...]``.

Two ways to build a catalog:

* ``Catalog.from_fixtures(spark, sf_dir)`` derives the catalog views of
  FIXTURES.md from the driver's parquet tables (test and bench input).
* ``Catalog.from_path(spark, root)`` reads a fleet layout
  ``root/<table>/`` (parquet, ``snapshot_date`` partitions pruned by filter).

Tables are read on first use, so a check that needs three tables scans
three tables; column pruning and pushed filters reach the parquet scan.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures_sql import VIEW_SQL

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# Namespaces never holding user objects.
EXCLUDED_NAMESPACES = ("pg_catalog", "information_schema", "spock", "pg_toast")

# Relation id of the tables that checks join by relation: their stored form is bucketed and sorted by it.
RELATION_KEYS = {"cat_class": "oid", "cat_attribute": "attrelid", "cat_constraint": "conrelid", "cat_index": "indrelid", "cat_table_stats": "relid",
                 "cat_inherits": "inhrelid", "cat_partitioned": "partrelid", "cat_policy": "polrelid", "cat_rewrite": "ev_class",
                 "cat_trigger": "tgrelid", "repset_table": "set_reloid", "user_classes": "oid"}

# Tables that a fleet may bring along: senders, and rules as rows (see ``checks.rules``).
OPTIONAL_TABLES = ["stat_replication", "rule_patterns", "rule_keywords", "rule_settings"]

_BASE_RE = re.compile(r"\b(" + "|".join(BASE_TABLES) + r")\b(?!\s*\()")


def spark_view_sql(name: str) -> str:
    """FIXTURES view text in Spark dialect, base tables as ``{param}`` slots."""
    sql = VIEW_SQL[name].replace("ARR(", "array(")
    sql = sql.replace("{", "{{").replace("}", "}}")
    # quoted literals never contain a base-table word, so a plain word swap is safe
    return _BASE_RE.sub(lambda m: "{" + m.group(1) + "}", sql)


def duckdb_view_sql(name: str) -> str:
    return VIEW_SQL[name].replace("ARR(", "list_value(")


class Catalog:
    def __init__(self, spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]],
                 keys: Iterable[str] = ("instance_id",),
                 excluded_namespaces: Iterable[str] = EXCLUDED_NAMESPACES):
        self.spark = spark
        self._loaders = dict(loaders)
        self._cache: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}         # tables that are files at rest, with their folders
        self._found: dict[str, bool] = {}
        self._memo: dict[tuple, DataFrame] = {}
        self._lock = threading.RLock()
        self.keys = list(keys)
        self.excluded_namespaces = list(excluded_namespaces)
        self.source = "catalog"          # "dump" for catalogs derived from schema dumps

    # -- access -------------------------------------------------------------
    def has(self, name: str) -> bool:
        """Whether the table can be read; a folder is looked up once in its own file system."""
        if name in self._paths and name not in self._found:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths[name])
            self._found[name] = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return name in self._loaders and self._found.get(name, True)

    def table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._cache:
                if name not in self._loaders:
                    raise KeyError(f"catalog table {name!r} is not available")
                self._cache[name] = self._loaders[name]()
            return self._cache[name]

    def memo(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """Build a shared projection once per catalog (plans are immutable)."""
        with self._lock:
            if key not in self._memo:
                self._memo[key] = build()
            return self._memo[key]

    __getitem__ = table

    def available(self) -> list[str]:
        return sorted(self._loaders)

    def materialize(self, names: Iterable[str] | None = None, tolerant: bool = False) -> "Catalog":
        """Store the given derived tables once, in the shared checkpoint folder, in co-located form.

        Tables with a relation id are bucketed and sorted by scope keys and
        relation, so that joins by relation need no exchange; all are Parquet,
        so later reads are pruned to the columns they use.  Tables that are
        files already are left alone.  ``tolerant``: a table that cannot be
        derived stays as it is, and fails in whatever reads it.
        """
        from concurrent.futures import ThreadPoolExecutor

        todo = [n for n in (names if names is not None else self.available()) if n in self._loaders and n not in self._paths]
        # independent small jobs: run them side by side so the cores stay busy
        with ThreadPoolExecutor(max_workers=max(1, min(8, len(todo)))) as pool:
            done = list(pool.map(lambda n: self._try(n, lambda: self.table(n), tolerant), todo))
        with self._lock:
            self._cache.update({n: df for n, df in zip(todo, done) if df is not None})
        return self

    def _try(self, name: str, build: Callable[[], DataFrame], tolerant: bool) -> DataFrame | None:
        try:
            return self._stored(name, build())
        except Exception:
            if not tolerant:
                raise
            return None

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back: bucketed by scope keys and relation where it has one."""
        from ..session import written
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])
        rel = RELATION_KEYS.get(name)
        return written(df, name, [*self.keys, rel] if rel in df.columns else None)

    def save_layout(self, prefix: str, path: str, buckets: int, partition_by: str | None = None) -> None:
        """Save every table as ``<prefix><table>`` in the session catalog, files under ``path``: bucketed and sorted by scope keys and
        relation, in partitions of ``partition_by`` (the snapshot date) where the table has that column."""
        from ..session import bucketed
        for name in self.available():
            df, rel = self.table(name), RELATION_KEYS.get(name)
            part = partition_by if partition_by in df.columns else None
            keys = [*self.keys, rel] if rel in df.columns else [c for c in self.keys if c in df.columns]
            bucketed(df, f"{prefix}{name}", f"{path.rstrip('/')}/{name}", keys, buckets, part)

    @classmethod
    def from_layout(cls, spark: SparkSession, prefix: str, snapshot_date: str | None = None, keys: Iterable[str] = ("instance_id",), **kw) -> "Catalog":
        """Catalog of the tables that ``save_layout`` has saved; a snapshot date prunes partitions."""
        def loader(t: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                df = spark.table(t)
                return df.filter(F.col("snapshot_date") == F.lit(snapshot_date)) if snapshot_date is not None and "snapshot_date" in df.columns else df
            return load

        names = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix.lower())]
        cat = cls(spark, {t[len(prefix):]: loader(t) for t in names}, keys=keys, **kw)
        cat._paths = {t: "" for t in cat._loaders}
        cat._found = {t: True for t in cat._loaders}
        return cat

    def without(self, *names: str) -> "Catalog":
        """A copy of this catalog with some inputs missing (for skip handling)."""
        out = Catalog(self.spark, {k: v for k, v in self._loaders.items() if k not in names},
                      self.keys, self.excluded_namespaces)
        out._paths = {k: v for k, v in self._paths.items() if k not in names}
        return out

    def materialize_shared(self, tolerant: bool = False) -> "Catalog":
        """Store the user-object projections most checks start from."""
        for name, build in (("user_namespaces", self.user_namespaces), ("user_classes", self.user_classes)):
            df = self._try(name, build, tolerant)
            with self._lock:
                if df is not None:
                    self._memo[(name,)] = df
        return self

    # -- shared projections used by many checks ------------------------------
    def instances(self) -> DataFrame:
        return self.table("instances")

    def user_namespaces(self) -> DataFrame:
        """Namespaces holding user objects: (keys, relnamespace, nspname)."""
        def build() -> DataFrame:
            ns = self.table("cat_namespace")
            return (ns.filter(~F.col("nspname").isin(*self.excluded_namespaces))
                      .select(*self.keys, F.col("oid").alias("relnamespace"), "nspname"))
        return self.memo(("user_namespaces",), build)

    def with_namespace(self, df: DataFrame, by: str) -> DataFrame:
        """``df`` (with relnamespace) joined to its user namespaces; ``by``: a column that varies inside a namespace.

        One namespace may hold all rows of an instance, so the few namespaces
        are replicated over salts and ``df`` is dealt to them by ``by``."""
        salts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ns = self.user_namespaces().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
        return dealt.join(ns, self.keys + ["relnamespace", "__salt"]).drop("__salt")

    def user_classes(self, *relkinds: str) -> DataFrame:
        """Relations in user namespaces with ``fqn`` = schema.name."""
        def build() -> DataFrame:
            whole = self._memo.get(("user_classes",))
            if relkinds and whole is not None:
                return whole.filter(F.col("relkind").isin(*relkinds))
            c = self.table("cat_class")
            if relkinds:
                c = c.filter(F.col("relkind").isin(*relkinds))
            return self.with_namespace(c, "oid").withColumn("fqn", F.concat_ws(".", "nspname", "relname"))
        return self.memo(("user_classes",) + tuple(sorted(relkinds)), build)

    # -- constructors --------------------------------------------------------
    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, **kw) -> "Catalog":
        base: dict[str, DataFrame] = {}

        def base_df(t: str) -> DataFrame:
            if t not in base:
                base[t] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
            return base[t]

        def loader(view: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                text = spark_view_sql(view)
                used = sorted(set(_BASE_RE.findall(VIEW_SQL[view])))
                return spark.sql(text, **{t: base_df(t) for t in used})
            return load

        return cls(spark, {v: loader(v) for v in VIEW_SQL}, **kw)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, tables: Iterable[str] | None = None,
                  fmt: str = "parquet", snapshot_date: str | None = None,
                  keys: Iterable[str] = ("instance_id", "snapshot_ts"), **kw) -> "Catalog":
        """Fleet layout: one folder per table, partitioned by ``snapshot_date``."""
        names = list(tables) if tables is not None else [*VIEW_SQL, *OPTIONAL_TABLES]

        def loader(t: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                df = spark.read.format(fmt).load(f"{root.rstrip('/')}/{t}")
                if snapshot_date is not None and "snapshot_date" in df.columns:
                    df = df.filter(F.col("snapshot_date") == F.lit(snapshot_date))
                return df
            return load

        cat = cls(spark, {t: loader(t) for t in names}, keys=keys, **kw)
        cat._paths = {t: f"{root.rstrip('/')}/{t}" for t in names}
        return cat
