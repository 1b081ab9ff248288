"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b: long); root is the component's smallest id.

    Each round hangs every neighbour on the smallest one; labels meet in a
    number of rounds that grows with the logarithm of the longest path.  Edges
    stay distributed; each round is written to the shared folder, so a lost
    executor costs one round.  Self-edges and repeated edges are harmless.
    """
    live = written(_tidy(edges), "cc")
    before = _digest(live)
    while True:
        big = written(_tidy(_star(live, larger=True)), "cc")       # one star a plan: a driver renders a plan anew after each of its steps
        live = written(_tidy(_star(big, larger=False)), "cc")
        now = _digest(live)
        if now == before:
            break
        before = now
    # stars now: every edge joins a vertex (a) to its root (b)
    return _either(live, ("a", "b"), ("b", "b")).toDF("id", "root").distinct()


def _digest(e: DataFrame):
    """Number of edges and the sums of two hashes of them: equal for equal sets of edges."""
    return tuple(e.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(38,0)")) for k in (1, 2)]).first())


def _tidy(e: DataFrame) -> DataFrame:
    """Distinct edges, larger end first."""
    return (e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _star(e: DataFrame, larger: bool) -> DataFrame:
    """Large star: hang larger neighbours on the smallest of the neighbourhood; small star: the smaller ones
    and the vertex itself.  ``e`` is named twice only: what it is made from counts as often in the plan."""
    if larger:
        both = _either(e, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return _either(e.join(low, "a"), ("b", "m"), ("a", "m"))


def _either(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b): a row for each of the column ``pairs`` of every row."""
    return e.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))
