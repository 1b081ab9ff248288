"""Reusable relational operators.

All but ``first_k`` are plain DataFrame compositions: they stay inside Catalyst
(no Python UDFs).  All are parameterised by column names so every check can
reuse them.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# The Arrow functions of this module run in Python workers: ship them by
# value so executors need not have the package installed.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


def _cols(xs: Sequence[str] | str) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


# -- r_prefix_cover_anti -------------------------------------------------------
def prefix_cover_anti(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                      right_keys: Sequence[str], left_arr: str, right_arr: str) -> DataFrame:
    """Rows of ``left`` with no ``right`` row (same keys) whose leading array
    elements equal ``left_arr`` in order.

    Planned as one LeftAnti join: equi keys drive the hash partitioning, the
    array prefix test is the residual condition evaluated per candidate pair.
    """
    r = right.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(right_keys)],
                     F.col(right_arr).alias("__r_arr"))
    cond = [left[k] == r[f"__r_{i}"] for i, k in enumerate(left_keys)]
    # the first elements are compared in place; a slice is cut only where they agree
    first = (F.size(left[left_arr]) < 1) | F.get("__r_arr", F.lit(0)).eqNullSafe(F.get(left[left_arr], F.lit(0)))
    residual = (F.size("__r_arr") >= F.size(left[left_arr])) & first & \
        (F.slice("__r_arr", 1, F.size(left[left_arr])) == left[left_arr])
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return left.join(r, on & residual, "left_anti")


# -- r_ordered_array_agg -------------------------------------------------------
def ordered_array_agg(value: str | Column, *order: str | Column) -> Column:
    """``array_agg(value ORDER BY order...)`` as an aggregate expression.

    Use only where the group is bounded by the catalog itself (columns of one
    key, indexes of one table); open-ended groups use ``group_list_preview``.
    """
    val = F.col(value) if isinstance(value, str) else value
    ords = [F.col(o) if isinstance(o, str) else o for o in order]
    if len(order) == 1 and isinstance(value, str) and value == order[0]:
        ords = []                               # ordered by itself: held once
    st = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ords)], val.alias("v"))
    return F.transform(F.array_sort(F.collect_list(st)), lambda s: s["v"])


# -- r_correlated_count --------------------------------------------------------
def correlated_count(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                     right_on: Sequence[str], out: str) -> DataFrame:
    """Per-row count of matching ``right`` rows (scalar subquery), 0 when none.

    The right side is aggregated first (map-side partial count), so the join
    sees one row per key however skewed the right side is.
    """
    counts = right.groupBy(*[F.col(r).alias(l) for l, r in zip(left_on, right_on)]) \
                  .agg(F.count(F.lit(1)).alias(out))
    return left.join(counts, list(left_on), "left") \
               .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint"))


# -- r_topk ----------------------------------------------------------------------
def topk(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int,
         rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per partition by ``order`` (ties broken by the caller's
    order columns).  ``row_number() <= k`` plans as WindowGroupLimit, which
    keeps at most ``k`` rows per group in each map task before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# -- ranks and first values over groups of any size ---------------------------------
def distributed_rank(df: DataFrame, partition: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with the rank (1, 2, ...; ``row_number``) of every row in its partition, without a window over one partition.

    Rows are range-partitioned by partition and order, and written once with
    their place in their range.  The ranges' sizes give each range its offset;
    a partition's first place is one ``min``.  A partition of a million rows is
    ranked by as many tasks as it has ranges."""
    p = list(partition)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*[F.col(c) for c in p], *order]
    placed = written(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    place = (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__off")).cast("long")
    sizes = placed.groupBy(F.shiftright("__id", 33).cast("int").alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    # one row a range, so this window is bounded by the number of shuffle partitions
    offsets = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__off"))
    at = placed.withColumn("__range", F.shiftright("__id", 33).cast("int")).join(F.broadcast(offsets), "__range").withColumn("__at", place)
    start = at.groupBy(*p).agg(F.min("__at").alias("__start"))
    return at.join(start, p).withColumn(out, (F.col("__at") - F.col("__start") + 1).cast("bigint")).drop("__id", "__range", "__off", "__at", "__start")


def first_k(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, k: int, weight: str | None = None) -> DataFrame:
    """(group..., count, kept) in one pass: the rows of each group (or the sum of ``weight``), and its first ``k`` non-null
    values by the ``order`` columns (ascending, nulls first).

    A mergeable aggregate: every task keeps a count and at most ``k`` values of each group it meets, the partial
    rows are shuffled by group and merged in a stream, so neither a task nor a cell holds more than ``k`` values of a group."""
    group, order = list(group), list(order)
    g, o = len(group), len(order)
    fields = [df.schema[c] for c in group]
    value_type = df.schema[value].dataType
    part = T.StructType([*[T.StructField(f"g{i}", f.dataType) for i, f in enumerate(fields)], *[T.StructField(f"o{i}", df.schema[c].dataType) for i, c in enumerate(order)],
                         T.StructField("v", value_type), T.StructField("n", T.LongType())])
    done = T.StructType([*fields, T.StructField("count", T.LongType()), T.StructField("kept", T.ArrayType(value_type))])
    part_arrow, done_arrow = _arrow_schema(part), _arrow_schema(done)
    place = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[g:g + o])

    def best(rows: list[tuple]) -> list[tuple]:
        return heapq.nsmallest(k, rows, key=place)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush():
            rows = []
            for key, (n, found) in held.items():
                found = best(found)
                rows += [(*r[:-1], n if i == 0 else 0) for i, r in enumerate(found)] or [(*key, *[None] * (o + 1), n)]
            held.clear()
            return _batches(rows, part_arrow)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                slot = held.setdefault(r[:g], [0, []])
                slot[0] += r[-1] or 0
                if r[-2] is not None:
                    slot[1].append(r)
                    if len(slot[1]) > 8 * k + 8:
                        slot[1] = best(slot[1])
            if len(held) > 50_000:
                yield from flush()
        yield from flush()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

        def merged():
            for key, own in itertools.groupby(rows, key=lambda r: r[:g]):
                n, found = 0, []
                for r in own:
                    n += r[-1]
                    if r[-2] is not None:
                        found.append(r)
                        if len(found) > 8 * k + 8:
                            found = best(found)
                yield *key, n, [r[-2] for r in best(found)]
        return _batches(merged(), done_arrow)

    src = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                    F.col(value).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    keys = [f"g{i}" for i in range(g)]
    return src.mapInArrow(partial, part).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, done)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _batches(rows, schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while block := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


# -- r_group_list_preview --------------------------------------------------------
def group_list_preview(df: DataFrame, group: Sequence[str], value: str | Column,
                       order: Sequence[Column], show: int = 10, keep: int = 20,
                       sep: str = ", ", prefix: str = "") -> DataFrame:
    """Per group: total count, first ``keep`` values in order (``kept``) and a
    display string of the first ``show`` values with ``...`` when cut.

    The count is a partial (map-side) aggregate; the kept list comes from a
    per-group row-number limit, so no group is ever collected whole.
    """
    val = F.col(value) if isinstance(value, str) else value
    group = list(group)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{prefix}count"))
    ranked = topk(df.withColumn("__v", val), group, order, keep, "__rn")
    kept = ranked.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__v"))), lambda s: s["__v"])
        .alias(f"{prefix}kept"))
    out = counts.join(kept, group)
    shown = F.array_join(F.slice(F.col(f"{prefix}kept"), 1, show), sep)
    return out.withColumn(
        f"{prefix}preview",
        F.when(F.col(f"{prefix}count") > show, F.concat(shown, F.lit("..."))).otherwise(shown))


# -- r_code_labels ---------------------------------------------------------------
def code_labels(code: str | Column, labels: Mapping[str, str]) -> Column:
    """Label of a one-character code with fallback to the code itself.

    The rule table is a literal map evaluated inside generated code; it is the
    broadcast join of a fixed-size rule table without the join."""
    c = F.col(code) if isinstance(code, str) else code
    m = F.create_map(*[x for kv in labels.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, c.cast("string")), c.cast("string"))


# -- r_keyword_any / r_keyword_all_hits --------------------------------------------
def keyword_any(text: str | Column, patterns: Sequence[str], case: str = "lower") -> Column:
    """True when the case-folded text contains any of ``patterns`` (substring)."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.lower(t) if case == "lower" else F.upper(t)
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(t, p) > 0)


def keyword_all_hits(text: str | Column, patterns: Sequence[str], case: str = "upper") -> Column:
    """Every pattern the case-folded text contains, in pattern order."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.upper(t) if case == "upper" else F.lower(t)
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(t, p) > 0)


# -- r_regex_scan ------------------------------------------------------------------
def regex_classes(text: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """All class names whose regex matches the text: one pass over the text
    builds the ``classes`` array for every rule."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(t.rlike(rx), F.lit(cls)) for cls, rx in rules]))


# -- r_setting_rule ------------------------------------------------------------------
def setting_rule_eval(value: Column, op: Column, target: Column) -> Column:
    """True when the setting violates its rule.  ``op``: eq (must equal),
    ne (must differ), min (numeric, must be >= target)."""
    num = value.try_cast("bigint") if hasattr(value, "try_cast") else F.expr("try_cast(value as bigint)")
    return (F.when(op == "eq", value != target)
             .when(op == "ne", value == target)
             .when(op == "min", num < target.cast("bigint"))
             .otherwise(F.lit(False)))


# -- ordered scans over huge partitions ------------------------------------------------
def block_running_sum(df: DataFrame, partition: Sequence[str], order: str, value: str, out: str,
                      block: Column, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per partition in ``order``, computed by blocks.

    Sums per block are aggregated first (map-side), the block offsets come
    from a window over the few block rows of each partition, and the running
    sum inside a block is a window over that block only.  A partition holding
    a third of all rows is therefore processed by as many tasks as it has
    blocks instead of one.
    """
    p = list(partition)
    d = df.withColumn("__blk", block)
    per_block = d.groupBy(*p, "__blk").agg(F.sum(value).alias("__bs"))
    wb = Window.partitionBy(*p).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("__off", F.coalesce(F.sum("__bs").over(wb), F.lit(0))).drop("__bs")
    wl = Window.partitionBy(*p, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.sum(value).over(wl)).join(offsets, p + ["__blk"])
    total = F.col("__off") + F.col("__in")
    if not inclusive:
        total = total - F.col(value)
    return d.withColumn(out, total.cast("bigint")).drop("__blk", "__in", "__off")


def block_carry_forward(df: DataFrame, partition: Sequence[str], order: str, value: str, out: str,
                        block: Column) -> DataFrame:
    """Last non-null ``value`` up to each row (``last(ignorenulls)``), by blocks."""
    p = list(partition)
    d = df.withColumn("__blk", block)
    per_block = (d.filter(F.col(value).isNotNull()).groupBy(*p, "__blk")
                  .agg(F.max_by(value, order).alias("__bl")))
    wb = Window.partitionBy(*p).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    wl = Window.partitionBy(*p, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.last(value, ignorenulls=True).over(wl))
    blocks = d.select(*p, "__blk").distinct()
    # blocks without any value still need the carried value of earlier blocks
    all_blocks = blocks.join(per_block.select(*p, "__blk", "__bl"), p + ["__blk"], "left")
    init = all_blocks.withColumn("__init", F.last("__bl", ignorenulls=True).over(wb)).drop("__bl")
    d = d.join(init, p + ["__blk"], "left")
    return d.withColumn(out, F.coalesce("__in", "__init")).drop("__blk", "__in", "__init")
