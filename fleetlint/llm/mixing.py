"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are the token shares raised to an exponent and normalised.  The
exponent (0: uniform, 1: as the corpus is) is bisected, many sections a pass,
so that the weights reach ``entropy`` times the largest possible entropy, but
no further than lets any source be repeated more than ``repeats`` times under
the budget.  Each pass is one aggregation over the table of sources.

A source's budget is dealt as whole epochs plus a part of one.  In an epoch the
documents stand in a block permutation: blocks of about ``BLOCK`` documents in
the order of a hash of (seed, epoch, source, block), documents inside by a hash
of (seed, epoch, document).  The part ends with the first document that
reaches the budget; where it ends is a (block, document) key per source, found
from block sums and one block's documents, so no source is ever gathered in
one task and texts are never shuffled.

Defined cases: a null source is a source of its own; null and empty texts have
no tokens, follow their source into whole epochs, and into the part if they
stand before its end; a source without tokens gets no weight and no rows; a
null doc_id counts as the text ``null``; repeated rows are dealt together, so
a part may end past its budget by the copies of its last document; an empty
table gives no rows.  Extra columns are passed through by ``deal``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .spans import written

BLOCK = 1024
SECTIONS = 32
PASSES = 6
KEY_DIGITS = 3                  # hexadecimal digits of a block key that name its range: 4096 ranges
#: the table of sources is broadcast up to this many rows (about 150 bytes each), else joined by shuffle
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Target:
    entropy: float = 0.95          # of ln(number of sources with tokens)
    repeats: float = 4.0
    budget: int | None = None      # tokens; None: as many as the corpus has
    seed: int = 13


def _source(c: str = "source"):
    return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c)))


def _tokens(c: str = "text"):
    return F.coalesce(F.regexp_count(F.col(c), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _doc_key(seed: int, epoch, doc_id: str = "doc_id"):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


def _block(seed: int, blocks, doc_id: str = "doc_id"):
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("block"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % blocks


def _block_key(seed: int, epoch):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("src"), F.col("block").cast("string")).cast("binary"))


def _measure(sources: DataFrame, total: int, budget: int, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest repetition) of the weights at each exponent, in one pass over the sources."""
    share = F.col("tokens") / F.lit(float(total))
    each = sources.select(share.alias("p"), F.posexplode(F.array(*[F.lit(x) for x in exponents])).alias("i", "x"))
    agg = (each.select("i", "p", "x", F.pow("p", F.col("x")).alias("w"))
               .groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("x") * F.log("p")).alias("l"),
                                 F.max(F.col("w") / F.col("p")).alias("r")))
    out: list = [None] * len(exponents)
    for r in agg.collect():
        out[r["i"]] = (math.log(r["z"]) - r["l"] / r["z"], r["r"] / r["z"] * budget / total)
    return out


def exponent(sources: DataFrame, n: int, total: int, budget: int, t: Target) -> float:
    """The bisected exponent: entropy first, raised if the repetition limit asks for it."""
    goal = t.entropy * math.log(n)
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):                      # largest exponent that still has the entropy
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        ok = [k for k, (h, _) in enumerate(_measure(sources, total, budget, grid)) if h >= goal]
        k = max(ok, default=0)
        if k == SECTIONS:
            lo = grid[k]
            break
        lo, hi = grid[k], grid[k + 1]
    by_entropy = lo
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):                      # smallest exponent within the limit
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        ok = [k for k, (_, r) in enumerate(_measure(sources, total, budget, grid)) if r <= t.repeats]
        k = min(ok, default=SECTIONS)
        if k == 0:
            hi = grid[0]
            break
        lo, hi = grid[k - 1], grid[k]
    return max(by_entropy, hi)


def plan(docs: DataFrame, t: Target = Target()) -> tuple[DataFrame, int]:
    """Per source: weight, whole epochs, and the keys at which the part of the next epoch ends; with
    the number of sources."""
    slim = written(docs.select("doc_id", _source().alias("src"), _tokens().alias("tokens")), "mixing")
    sources = written(slim.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"), "sources")
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return sources.select("src", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epochs"), F.lit(1).cast("long").alias("blocks"),
                              F.lit(None).cast("string").alias("cut_block"), F.lit(None).cast("string").alias("cut_doc")), 0
    budget = total if t.budget is None else t.budget
    x = exponent(sources, n, total, budget, t)
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x)))).first()[0]
    dealt = (sources.withColumn("weight", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x)) / F.lit(z))
                    .withColumn("target", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
                    .withColumn("epochs", F.expr("target div tokens"))
                    .withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens"))
                    .withColumn("blocks", F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long")))
    dealt = written(dealt, "dealt")
    small = _sized(dealt.select("src", "epochs", "blocks", "rest"), n)
    placed = (slim.join(small, "src").filter("rest > 0").withColumn("block", _block(t.seed, F.col("blocks"))))
    sums = (placed.groupBy("src", "epochs", "rest", "block").agg(F.sum("tokens").alias("tokens"))
                  .withColumn("key", _block_key(t.seed, F.col("epochs"))))
    # keys are uniform hashes: their first digits deal a source's blocks into 16**KEY_DIGITS ranges, whose sums
    # name the one range in which the rest ends; only its blocks are added up one by one
    sums = sums.withColumn("range", F.substring("key", 1, KEY_DIGITS))
    upto = Window.partitionBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sums.groupBy("src", "rest", "range").agg(F.sum("tokens").alias("held")).withColumn("upto", F.sum("held").over(upto.orderBy("range")))
    ranges = ranges.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("held") < F.col("rest"))).select(
        "src", "range", (F.col("upto") - F.col("held")).alias("before"))
    edge = (sums.join(_sized(ranges, n), ["src", "range"]).withColumn("end", F.col("before") + F.sum("tokens").over(upto.orderBy("key", "block")))
                .filter((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("tokens") < F.col("rest")))
                .select("src", "block", F.col("key").alias("cut_block"), (F.col("rest") - F.col("end") + F.col("tokens")).alias("left")))
    inside = placed.join(_sized(edge, n), ["src", "block"]).withColumn("key", _doc_key(t.seed, F.col("epochs")))
    v = Window.partitionBy("src").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (inside.withColumn("end", F.sum("tokens").over(v)).filter(F.col("end") >= F.col("left"))
                 .groupBy("src", "cut_block").agg(F.min("key").alias("cut_doc")))
    return written(dealt.select("src", "weight", "epochs", "blocks").join(cut, "src", "left"), "plan"), n


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def deal(docs: DataFrame, t: Target = Target()) -> DataFrame:
    """``docs`` as dealt: a row per document and epoch with epoch, block, block_key and doc_key.

    The mixed stream is the rows ordered by (epoch, block_key, doc_key).
    Columns of these names in ``docs`` are replaced.
    """
    made = ["epoch", "block", "block_key", "doc_key", "weight"]
    cols = [c for c in docs.columns if c not in made]
    sources, n = plan(docs, t)
    last = F.col("_p.epochs")
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")
    out = (docs.select(row, "doc_id", _source().alias("_src"))
               .join(_sized(sources.select(F.col("src").alias("_src"), F.struct("weight", "epochs", "blocks", "cut_block", "cut_doc").alias("_p")), n), "_src")
               .withColumn("block", _block(t.seed, F.col("_p.blocks")))
               .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
               .withColumnRenamed("_src", "src")
               .withColumn("block_key", _block_key(t.seed, F.col("epoch"))).withColumn("doc_key", _doc_key(t.seed, F.col("epoch"))))
    whole = F.col("epoch") < last
    part = F.col("_p.cut_block").isNotNull() & ((F.col("block_key") < F.col("_p.cut_block"))
                                               | ((F.col("block_key") == F.col("_p.cut_block")) & (F.col("doc_key") <= F.col("_p.cut_doc"))))
    return out.filter(whole | part).select("_row.*", "epoch", "block", "block_key", "doc_key", F.col("_p.weight").alias("weight"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents: one row per document and epoch in which it is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return deal(docs).select("doc_id", "source", _tokens().alias("tokens"), "epoch", "block", "block_key", "doc_key", "weight")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The final corpus: documents as often as their source's weight asks, with their order keys."""
    return deal(docs)


def _bisect_sql(name: str, test: str, pick: str) -> str:
    """Recursive DuckDB CTE that repeats the sections of ``exponent``."""
    return f"""
{name} AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, false AS done
  UNION ALL
  SELECT step + 1, {pick}
  FROM (
    SELECT b.step, b.lo, b.hi, max(g.k) FILTER (WHERE {test}) AS kmax, min(g.k) FILTER (WHERE {test}) AS kmin
    FROM {name} b, LATERAL (
      SELECT k, ln(sum(w)) - sum(w * x * ln(p)) / sum(w) AS h, max(w / p) / sum(w) AS r
      FROM (SELECT k, p, b.lo + (b.hi - b.lo) * k / {SECTIONS} AS x, pow(p, b.lo + (b.hi - b.lo) * k / {SECTIONS}) AS w
            FROM shares, range(0, {SECTIONS + 1}) t(k)) e
      GROUP BY k) g
    WHERE b.step < {PASSES} AND NOT b.done
    GROUP BY b.step, b.lo, b.hi) s
)"""


ORACLE = f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
src AS (SELECT src, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY src HAVING sum(tokens) > 0),
tot AS (SELECT count(*) AS n, sum(tokens)::DOUBLE AS total FROM src),
shares AS (SELECT tokens / total AS p FROM src, tot),
""" + _bisect_sql("ent", f"g.h >= {Target.entropy} * ln((SELECT n FROM tot))",
                  f"lo + (hi - lo) * coalesce(kmax, 0) / {SECTIONS}, CASE WHEN kmax = {SECTIONS} THEN hi ELSE lo + (hi - lo) * (coalesce(kmax, 0) + 1) / {SECTIONS} END, coalesce(kmax, 0) = {SECTIONS}") + "," + _bisect_sql(
    "rep", f"g.r <= {Target.repeats}",
    f"CASE WHEN kmin = 0 THEN lo ELSE lo + (hi - lo) * (coalesce(kmin, {SECTIONS}) - 1) / {SECTIONS} END, lo + (hi - lo) * coalesce(kmin, {SECTIONS}) / {SECTIONS}, coalesce(kmin, {SECTIONS}) = 0") + f""",
x AS (SELECT greatest((SELECT arg_max(lo, step) FROM ent), (SELECT arg_max(hi, step) FROM rep)) AS x),
w AS (SELECT src, tokens, ceil(docs / {float(BLOCK)})::BIGINT AS blocks, pow(tokens / total, x) / (SELECT sum(pow(p, x)) FROM shares, x) AS weight,
             total FROM src, tot, x),
pl AS (SELECT *, floor(weight * total)::BIGINT // tokens AS epochs, floor(weight * total)::BIGINT % tokens AS rest FROM w),
docs2 AS (SELECT d.doc_id, d.source, d.src, d.tokens, pl.weight, pl.epochs, pl.rest,
               ('0x' || substr(md5('{Target.seed}|block|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % pl.blocks AS block
        FROM d JOIN pl USING (src)),
ep AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM docs2),
kd AS (SELECT *, md5('{Target.seed}|' || epoch || '|' || src || '|' || block) AS block_key,
               md5('{Target.seed}|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')) AS doc_key FROM ep),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY src, epoch ORDER BY block_key, block, doc_key RANGE UNBOUNDED PRECEDING), 0)
               - sum(tokens) OVER (PARTITION BY src, epoch, block_key, block, doc_key) AS before FROM kd)
SELECT doc_id, source, tokens, epoch, block, block_key, doc_key, weight FROM run
WHERE epoch < epochs OR (rest > 0 AND before < rest)
"""
