"""N-gram Jaccard join by set relations: families share index entries, answers derived from similar sets.

A document's set holds its distinct shingles of ``k`` words (words
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words: the whole sequence).
Documents link when ``100 * |A & B| >= percent * |A | B|``.  The query takes
``SHINGLE`` and ``PERCENT`` (its contract), the pipeline's stage ``STAGE_SHINGLE``
and ``STAGE_PERCENT``.  All links between different sets count; the answer is
the class (connected component) of every document.

1. One pass over the texts gives every set's size, 128-bit signature, three
   min-hashes and a 256-bit parity bitmap, and per task a fixed-size sketch of
   shingle counts over all rows, which only orders shingles (rare first).
2. Equal sets are one representative (smallest doc_id).
3. Highly similar sets: representatives that share a min-hash are compared with
   the smallest of their group; verified ones form families with a root; every
   member's exact distance to the root is computed.
4. Index: every representative posts its prefix (the rarest shingles that any
   partner must share one of).  Only shingles of two or more families are kept.
   A family has one entry a shingle and size band, however many rows it has;
   probing skips what positions, sizes and the roots' bitmaps exclude, and gives
   pairs of families.
5. Answers are computed once for pairs of family roots.  A member's answer
   follows from its root's by the triangle inequality of the Jaccard distance
   (linked families are one class already; pairs that the bound, their sizes or
   bitmaps exclude are skipped); only undecided pairs are read and compared.
6. Components of verified links.

Every comparison is exact on shingle hashes of the whole texts (64 bits).

Defined cases: null and empty texts and texts without words have an empty set
and their own doc_id as component; a null doc_id has its n_shingles, a null
component and takes no part in links; rows that share a doc_id are one vertex;
repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import in_filter, membership
from .graph import components
from .spans import release, written
from .textops import byte_table, column_bytes, give_back, map_text, mix64, row_chunks, small_batches, split_words, word_hashes

SHINGLE = 4
PERCENT = 85
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
NOT_BLANK = byte_table(lambda b: b not in (9, 10, 11, 12, 13, 32))
SKETCH_BITS = 20
SKETCH_PARTS = 64
BITMAP_WORDS = 4
#: id lists up to this length (8 bytes each) are broadcast as filters; longer ones are joined by shuffle
BROADCAST_IDS = 200_000
_SEEDS = mix64(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, sorted and distinct within each row; first shingle of each row plus the end)."""
    folded, s, e, rows = split_words(data, off, NOT_BLANK)
    h = word_hashes(folded, s, e)
    n = len(rows) - 1
    words = np.diff(rows)
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    row = np.repeat(np.arange(n), words)
    left = rows[1:][row] - np.arange(len(h))              # words from here to the row's end
    span = np.minimum(words, k)[row]
    head = left >= span                                   # a shingle (or the whole short row) starts here
    first = np.flatnonzero(head)
    g = np.zeros(len(first), np.uint64)
    size = span[first]
    for j in range(k):
        more = size > j
        g[more] = mix64(g[more] * np.uint64(0xD1342543DE82EF95) + h[first[more] + j] + np.uint64(j))
    r = row[first]
    o = np.lexsort((g, r))
    g, r = g[o], r[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    return g, np.searchsorted(r, np.arange(n + 1))


def _per_row(values: np.ndarray, rows: np.ndarray, how: np.ufunc) -> np.ndarray:
    out = np.zeros(len(rows) - 1, np.uint64)
    full = np.flatnonzero(rows[1:] > rows[:-1])
    if len(full):
        out[full] = how.reduceat(values, rows[full])
    return out


PROFILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType())]
                       + [T.StructField(c, T.LongType()) for c in ("s1", "s2", "k1", "k2", "k3")]
                       + [T.StructField(f"b{i}", T.LongType()) for i in range(BITMAP_WORDS)]
                       + [T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def profiles(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Rows with ``part`` null: one per document; other rows: the task's sketch, in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen = False
        for b in batches:
            _, off = column_bytes(b.column(1))
            for lo, hi in row_chunks(off):
                g, rows = shingles(*column_bytes(b.column(1).slice(lo, hi - lo)), k)
                place, times = np.unique((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                sketch[place] += times.astype(np.uint32)
                seen = True
                cols = [_per_row(mix64(g + _SEEDS[i]), rows, np.add) for i in (0, 1)]
                cols += [_per_row(mix64(g ^ _SEEDS[i]), rows, np.minimum) for i in (2, 3, 4)]
                bit = mix64(g + _SEEDS[5])
                for w in range(BITMAP_WORDS):
                    own = ((bit >> np.uint64(6)) % np.uint64(BITMAP_WORDS)) == w
                    cols.append(_per_row(np.where(own, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), rows, np.bitwise_xor))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(np.diff(rows), pa.int64())] + [pa.array(c.view(np.int64)) for c in cols]
                    + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=PROFILE.names)
        if seen:
            parts = sketch.reshape(SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_PARTS, pa.int64()) for _ in range(len(PROFILE) - 2)]
                + [pa.array(np.arange(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=PROFILE.names)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def sketch_of(profile: DataFrame) -> np.ndarray:
    """The summed sketch (4 bytes times 2**SKETCH_BITS, whatever the corpus)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)
                total[p] = total[p] + a if p in total else a
        for p, a in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.minimum(a, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    rows = (profile.filter("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part")
                   .mapInArrow(run, "part int, counts binary").collect())
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def prefixes(spark: SparkSession, docs: DataFrame, sketch: np.ndarray, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, prefix): each set's rarest shingles, in order; as many as any partner must share one of."""
    shared = spark.sparkContext.broadcast(sketch)

    def kernel(col: pa.Array) -> list[pa.Array]:
        g, rows = shingles(*column_bytes(col), k)
        n = np.diff(rows)
        r = np.repeat(np.arange(len(n)), n)
        o = np.lexsort((g, shared.value[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], r))
        g = g[o]
        keep = n - (-(-percent * n // 100)) + 1                  # n - ceil(percent n / 100) + 1
        keep = np.where(n > 0, keep, 0)
        at = np.arange(len(g)) - rows[:-1][r]
        g = g[at < keep[r]]
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(g.view(np.int64)))]

    return map_text(docs, "text", ["doc_id"], [T.StructField("prefix", T.ArrayType(T.LongType()))], kernel)


def _postings(spark: SparkSession, pre: DataFrame, wide: DataFrame) -> DataFrame:
    """(n, root, d, p, token) of prefix shingles that pass a bit filter of the wanted ones (the exact
    join follows), so the others are never shuffled again."""
    bits, size = membership(wide.withColumnRenamed("token", "h"), wide.count())
    shared = spark.sparkContext.broadcast((bits, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, b = shared.value
        for rb in batches:
            col = rb.column(3)
            token = col.flatten().to_numpy()
            count = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            ok = in_filter(f, b, token.view(np.uint64))
            take = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([rb.column(i).take(take) for i in range(3)] + [pa.array(at[ok].astype(np.int32)), pa.array(token[ok])],
                                             names=["n", "root", "d", "p", "token"])
        give_back()

    return pre.select("n", "root", "d", "prefix").mapInArrow(run, "n long, root long, d double, p int, token long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (one column doc_id, distinct, written)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def compare(docs: DataFrame, pairs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(a, b, inter, size) of written distinct (a, b) pairs: exact intersection and union sizes."""
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0).cast("long").alias("inter"), F.lit(0).cast("long").alias("size")).filter("false")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = _only(docs.select("doc_id", "text"), ids).dropDuplicates(["doc_id", "text"])
    both = (pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                 .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            _, oa = column_bytes(rb.column(2))
            _, ob = column_bytes(rb.column(3))
            for lo, hi in row_chunks(oa + ob):
                n = hi - lo
                ga, ra = shingles(*column_bytes(rb.column(2).slice(lo, n)), k)
                gb, rb_ = shingles(*column_bytes(rb.column(3).slice(lo, n)), k)
                g = np.concatenate([ga, gb])
                r = np.concatenate([np.repeat(np.arange(n), np.diff(ra)), np.repeat(np.arange(n), np.diff(rb_))])
                o = np.lexsort((g, r))
                g, r = g[o], r[o]
                same = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
                inter = np.bincount(r[1:][same], minlength=n)
                union = np.diff(ra) + np.diff(rb_) - inter
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, n), rb.column(1).slice(lo, n), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                                                 names=["a", "b", "inter", "size"])
        give_back()

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, size long")


def _possible(x: str, y: str, percent: int):
    """Whether sizes and bitmaps of two rows (columns n<x>, b0<x>...) allow a link."""
    n = F.col(f"n{x}") + F.col(f"n{y}")
    apart = sum(F.bit_count(F.col(f"b{i}{x}").bitwiseXOR(F.col(f"b{i}{y}"))) for i in range(BITMAP_WORDS))
    return ((100 * F.least(f"n{x}", f"n{y}") >= percent * F.greatest(f"n{x}", f"n{y}"))
            & (100 * (n - apart) >= percent * (n + apart)))


_BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def links(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profile per document with its representative ``rep``, verified links (a, b))."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(profiles(docs, k), "sets")
    prof = table.filter("part is null").drop("part", "counts")
    same = prof.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("k1", "k2", "k3", *_BITS)])
    reps = written(same, "reps")
    docrep = prof.select("doc_id", "n", "s1", "s2").join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    docrep = written(docrep.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "docrep")

    release(spark)
    # 3. families of highly similar sets
    lead = None
    for key in ("k1", "k2", "k3"):
        # the group's smallest representative with its size and bitmap; a bounded aggregate, so a group of any size is combined before the shuffle
        head = reps.groupBy(key).agg(F.min(F.struct("rep", "n", *_BITS)).alias("h"), F.count("*").alias("m")).filter("m > 1")
        one = (reps.select("rep", F.col("n").alias("nx"), *[F.col(b).alias(f"{b}x") for b in _BITS], key).join(head, key)
                   .select("rep", "nx", *[f"{b}x" for b in _BITS], F.col("h.rep").alias("b"), F.col("h.n").alias("ny"), *[F.col(f"h.{b}").alias(f"{b}y") for b in _BITS])
                   .filter((F.col("rep") != F.col("b")) & _possible("x", "y", percent)).select(F.col("rep").alias("a"), "b"))
        lead = one if lead is None else lead.union(one)
    lead = written(lead.distinct(), "leaders")
    checked = written(compare(docs, lead, k).filter(f"100 * inter >= {percent} * size"), "families")
    family = components(checked.select("a", "b"))
    near = checked.select(F.col("a").alias("id"), F.col("b").alias("root"), "inter", "size")
    far = written(family.filter("id <> root").join(near, ["id", "root"], "left_anti").select(F.col("id").alias("a"), F.col("root").alias("b")), "far")
    apart = near.union(compare(docs, far, k)).groupBy("id", "root").agg(F.max(1 - F.col("inter") / F.col("size")).alias("d"))
    members = reps.join(family.join(apart, ["id", "root"], "left").select(F.col("id").alias("rep"), "root", "d"), "rep", "left")
    members = written(members.select("rep", "n", *_BITS, F.coalesce("root", "rep").alias("root"),
                                     F.when(F.col("root").isNull() | (F.col("root") == F.col("rep")), F.lit(0.0)).otherwise(F.coalesce("d", F.lit(1.0))).alias("d")), "members")

    release(spark)
    # 4. the index
    pre = prefixes(spark, docs, sketch_of(table), k, percent).join(members.select(F.col("rep").alias("doc_id"), "n", "root", "d"), "doc_id")
    pre = written(pre.filter(F.size("prefix") > 0), "prefixes")
    post = pre.select("root", F.explode("prefix").alias("token"))
    wide = written(post.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token"), "tokens")
    index = written(family_index(_postings(spark, pre, wide).join(wide, "token"), members, percent), "index")
    pairs = written(family_hits(index, percent).select("a", "b").distinct(), "pairs")

    release(spark)
    # 5. answers of the roots, then what they leave open
    top = written(compare(docs, pairs, k), "answers")
    linked = top.filter(f"100 * inter >= {percent} * size").select("a", "b")
    limit = 1 - percent / 100 + 1e-9
    reach = members.groupBy("root").agg(F.max("d").alias("reach"))
    gap = (top.groupBy("a", "b").agg(F.min(1 - F.col("inter") / F.col("size")).alias("gap")).filter(F.col("gap") > limit)
              .join(reach.select(F.col("root").alias("a"), F.col("reach").alias("fa")), "a").join(reach.select(F.col("root").alias("b"), F.col("reach").alias("fb")), "b")
              .filter((F.col("fa") + F.col("fb") > 0) & (F.col("gap") - F.col("fa") - F.col("fb") <= limit)).select(F.col("a").alias("rootx"), F.col("b").alias("rooty"), "gap", "fb"))
    own = lambda x: members.select(*[F.col(c).alias(f"{c}{x}") for c in ("rep", "n", "root", "d", *_BITS)])
    half = gap.join(own("x"), "rootx").filter(F.col("gap") - F.col("dx") - F.col("fb") <= limit)
    rest = (half.join(own("y"), "rooty")
                .filter(((F.col("repx") != F.col("rootx")) | (F.col("repy") != F.col("rooty"))) & (F.col("gap") - F.col("dx") - F.col("dy") <= limit) & _possible("x", "y", percent)))
    rest = written(rest.select(F.col("repx").alias("a"), F.col("repy").alias("b")).distinct(), "open")
    more = compare(docs, rest, k).filter(f"100 * inter >= {percent} * size").select("a", "b")
    return docrep, written(checked.select("a", "b").union(linked).union(more), "links")


def family_index(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """One row per token, size band and family of the ``postings`` (n, root, d, p, token), whatever the family's size:
    the bounds of its rows, with the size and bitmap of the family's root."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / (percent - 0.1)))))
    own = postings.groupBy("token", band.alias("band"), "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("p")).alias("left"), F.max("d").alias("d"))
    return own.join(members.filter("rep = root").select("root", F.col("n").alias("m"), *_BITS), "root")


def family_hits(index: DataFrame, percent: int) -> DataFrame:
    """Pairs of families (a > b, roots; repeated) that share a token and whose rows may link.

    The first common token of two linked sets, in the order of the index, lies before what they have in common, so
    as much must be left of both from there on.  Bitmaps bound the distance of the roots from below, and rows of two
    families are closer than their roots by no more than their distances to them."""
    side = lambda x: index.select("token", "band", *[F.col(c).alias(f"{c}{x}") for c in ("root", "lo", "hi", "left", "d", "m", *_BITS)])
    probe = side("x").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("down")).withColumn("band", F.col("band") - F.col("down"))
    total = F.col("mx") + F.col("my")
    apart = sum(F.bit_count(F.col(f"b{i}x").bitwiseXOR(F.col(f"b{i}y"))) for i in range(BITMAP_WORDS))
    hits = probe.join(side("y"), ["token", "band"]).filter(
        (F.col("rootx") != F.col("rooty")) & ((F.col("down") == 1) | (F.col("rooty") < F.col("rootx")))
        & (100 * F.least("hix", "hiy") >= percent * F.greatest("lox", "loy"))
        & ((100 + percent) * F.least("leftx", "lefty") >= percent * (F.col("lox") + F.col("loy")))
        & (2 * apart / (total + apart) - F.col("dx") - F.col("dy") <= 1 - percent / 100 + 1e-9))
    return hits.select(F.greatest("rootx", "rooty").alias("a"), F.least("rootx", "rooty").alias("b"))


def classes(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) of every distinct non-null doc_id."""
    docrep, found = links(spark, docs, k, percent)
    release(spark)
    vertex = docrep.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    shared = docrep.join(vertex.filter("rep < other").select("doc_id", F.col("rep").alias("low")), "doc_id").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    comp = components(found.union(shared))
    return (vertex.select("doc_id", "rep").join(comp.select(F.col("id").alias("rep"), "root"), "rep", "left")
                  .select("doc_id", F.coalesce("root", "rep").alias("component_id")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, n_shingles, component_id for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def kernel(col: pa.Array) -> list[pa.Array]:
        return [pa.array(np.diff(shingles(*column_bytes(col), SHINGLE)[1]), pa.int64())]

    sizes = map_text(docs, "text", ["doc_id"], [T.StructField("n_shingles", T.LongType())], kernel)
    return sizes.join(classes(spark, docs, SHINGLE, PERCENT), "doc_id", "left").select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One doc_id of each class stays: the one that is the class id, with all its rows (repeated rows and
    different texts under that doc_id stay); rows without words or without doc_id stay as they are, copies included."""
    comp = classes(spark, docs, STAGE_SHINGLE, STAGE_PERCENT)
    gone = written(comp.filter("doc_id <> component_id").select("doc_id"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
