"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (``SAMPLE_ROWS``, ``SAMPLE_BYTES``) gives a neighbour
graph.  Recursive bisection at the median of the graph's second eigenvector,
refined by exchanging badly placed pairs, cuts it into balanced parts.  A small
network (one hidden layer, numpy) learns the parts of each sampled vector's
neighbours.  It places every row of the table in its most probable part and
routes each query to its ``probes`` most probable parts; ``probes`` is the smallest
number that finds ``RECALL`` of the true neighbours of held-back sample queries.

Rerank: parts are split into blocks of about ``BLOCK`` rows and their queries
into chunks of about ``BLOCK`` queries, so one part may hold any share of the
rows; a task holds one block and one chunk.  A matrix product selects, then the
measure is computed pair by pair in double precision, so equal vectors tie
exactly.  The nearest of the blocks are merged per query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those whose length is not the most common one
(ties: the smallest) or whose vec_id is null; rows equal in vec_id and vector
count once; a candidate with the query's own vec_id is not returned; with fewer
than ``k`` candidates all are returned; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .spans import written

SAMPLE_ROWS = 8192
SAMPLE_BYTES = 32 << 20
PART_ROOT = 5                   # parts: the square root of the rows over this, at most MAX_PARTS
MAX_PARTS = 256
NEIGHBOURS = 10
HIDDEN = 64
RECALL = 0.97
BLOCK = 4096


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    good = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    size = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return good.filter(F.size("v") == (size[0]["d"] if size else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indices of the k nearest other rows of every unit row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(nb: np.ndarray, levels: int, seed: int = 5) -> np.ndarray:
    """Part of every vertex: ``levels`` balanced bisections of the graph, 2**levels equal parts."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(nb), np.int64)
    a = np.repeat(np.arange(len(nb)), nb.shape[1])
    b = nb.reshape(-1)
    for _ in range(levels):
        same = part[a] == part[b]
        i, j = np.concatenate([a[same], b[same]]), np.concatenate([b[same], a[same]])
        deg = np.bincount(i, minlength=len(nb)) + 1.0
        y = rng.normal(size=len(nb))
        size = np.bincount(part)
        for _ in range(60):                      # power steps towards the second eigenvector of each part
            y -= (np.bincount(part, y * deg) / np.maximum(np.bincount(part, deg), 1e-9))[part]
            y = (y + np.bincount(i, y[j], len(nb)) / deg) / 2
            y /= np.sqrt(np.bincount(part, y * y) / np.maximum(size, 1) + 1e-30)[part]
        o = np.lexsort((y, part))
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = np.empty(len(nb), np.int64)
        place[o] = np.arange(len(nb)) - start[part[o]]
        side = (place >= (size[part] + 1) // 2).astype(np.int64)
        for _ in range(4):                       # exchange vertices that have more neighbours across, pair by pair
            own = np.bincount(i, side[i] == side[j], len(nb)) - np.bincount(i, side[i] != side[j], len(nb))
            for p in range(len(size)):
                here = np.flatnonzero((part == p) & (own < 0))
                l, r = here[side[here] == 0], here[side[here] == 1]
                m = min(len(l), len(r)) // 2
                side[l[np.argsort(own[l], kind="stable")[:m]]] = 1
                side[r[np.argsort(own[r], kind="stable")[:m]]] = 0
        part = part * 2 + side
    return part


def train_router(x: np.ndarray, part: np.ndarray, nb: np.ndarray, parts: int, epochs: int = 25, seed: int = 5) -> dict:
    """Network that predicts the parts of a vector and its neighbours."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = {"w": rng.normal(0, 1.0, (d, HIDDEN)), "b": np.zeros(HIDDEN), "u": rng.normal(0, 0.1, (HIDDEN + d, parts)), "c": np.zeros(parts)}
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), nb.shape[1]), part[nb].reshape(-1)), 1.0)
    goal[np.arange(len(x)), part] += nb.shape[1] or 1
    goal /= goal.sum(1, keepdims=True)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    t = 0
    for _ in range(epochs):
        o = rng.permutation(len(x))
        for lo in range(0, len(o), 128):
            q = o[lo:lo + 128]
            h, z = _forward(m, x[q])
            p = _softmax(z)
            dz = (p - goal[q]) / len(q)
            hx = np.hstack([h, x[q]])
            dh = dz @ m["u"][:HIDDEN].T * (h > 0)
            t += 1
            for k, g in (("u", hx.T @ dz), ("c", dz.sum(0)), ("w", x[q].T @ dh), ("b", dh.sum(0))):
                a, v = mom[k]
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                m[k] = m[k] - 0.01 * (a / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return m


def _forward(m, x):
    h = np.maximum(x @ m["w"] + m["b"], 0)
    return h, np.hstack([h, x]) @ m["u"] + m["c"]


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def route(m: dict, x: np.ndarray, probes: int) -> np.ndarray:
    """The most probable parts of unit vectors, best first."""
    return np.argsort(-_forward(m, x)[1], axis=1, kind="stable")[:, :probes]


def fit(sample: np.ndarray, rows: int) -> tuple[dict | None, int, int]:
    """(router, parts, probes) from sampled unit vectors, for a table of ``rows``."""
    levels = int(np.floor(np.log2(max(1.0, min(MAX_PARTS, np.sqrt(rows) / PART_ROOT, len(sample) / 24)))))
    if levels < 1:
        return None, 1, 1
    held = np.arange(len(sample)) % 10 == 0                # queries for the choice of probes: no training
    base = sample[~held]
    nb = neighbour_graph(base)
    part = balanced_parts(nb, levels)
    m = train_router(base, part, nb, 1 << levels)
    where = route(m, base, 1)[:, 0]
    q = sample[held]
    near = np.argpartition(-(q @ base.T), 4, axis=1)[:, :5]
    order = route(m, q, 1 << levels)
    rank = np.argsort(order, axis=1)                       # place of each part in the query's order
    need = rank[np.arange(len(q))[:, None], where[near]]
    for probes in range(1, (1 << levels) + 1):
        if (need < probes).mean() >= RECALL:
            break
    return m, 1 << levels, probes


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by cosine.

    ``vectors`` and ``queries`` hold vec_id and embedding.
    """
    base = written(clean(vectors), "vectors")
    asked = clean(queries)
    n = base.count()
    dim = base.select(F.size("v")).first()
    dim = dim[0] if dim else 1
    take = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    got = base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).select("v").toArrow()
    sample = np.array(got.column("v").combine_chunks().flatten() if got.num_rows else [], float).reshape(-1, dim)
    router, parts, probes = fit(np.unique(_unit(sample), axis=0), n) if len(sample) else (None, 1, 1)
    shared = spark.sparkContext.broadcast(router)

    def placed(df: DataFrame, many: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    s = b.slice(lo, BLOCK)
                    x = s.column(1).flatten().to_numpy().reshape(s.num_rows, dim)
                    to = np.zeros((s.num_rows, 1), np.int64) if shared.value is None else route(shared.value, _unit(x), many)
                    at = pa.array(np.repeat(np.arange(s.num_rows), to.shape[1]))
                    yield pa.RecordBatch.from_arrays([s.column(0).take(at), s.column(1).take(at), pa.array(to.reshape(-1).astype(np.int32))], names=["vec_id", "v", "part"])
        return df.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, part int")

    rows = placed(base, 1)
    asks = placed(asked, probes)
    # blocks and chunks of each part (one row per part)
    blocks = {r["part"]: max(1, -(-r["n"] // BLOCK)) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    chunks = {r["part"]: max(1, -(-r["n"] // BLOCK)) for r in asks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    plan = [(p, b, chunks.get(p, 0)) for p, b in blocks.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "part int, blocks int, chunks int"))      # at most MAX_PARTS rows
    h = lambda seed: F.xxhash64("vec_id", F.lit(seed))
    left = (rows.join(plan_df, "part").filter("chunks > 0").withColumn("block", F.pmod(h(1), F.col("blocks")).cast("int"))
                .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("part", "block", "chunk", "vec_id", "v"))
    right = (asks.join(plan_df, "part").withColumn("chunk", F.pmod(h(2), F.col("chunks")).cast("int"))
                 .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "block", "chunk", F.col("vec_id").alias("query_id"), F.col("v").alias("q")))

    def rerank(key, c: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not c.num_rows or not q.num_rows:
            return empty
        ci, cv = _table(c, "vec_id", "v", dim, k + 1)
        qi, qv = _table(q, "query_id", "q", dim, None)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), nearest(qi, qv, ci, cv, k))))

    found = left.groupBy("part", "block", "chunk").cogroup(right.groupBy("part", "block", "chunk")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _table(t: pa.Table, name: str, vec: str, dim: int, copies: int | None):
    """Ids and vectors, distinct; of equal vectors only the ``copies`` smallest ids (no others can be among the nearest)."""
    ids = t.column(name).to_numpy()
    x = np.ascontiguousarray(t.column(vec).combine_chunks().flatten().to_numpy().reshape(len(ids), dim))
    _, same = np.unique(x, axis=0, return_inverse=True)
    same = same.reshape(-1)
    o = np.lexsort((ids, same))
    new = np.ones(len(o), bool)
    new[1:] = (same[o][1:] != same[o][:-1]) | (ids[o][1:] != ids[o][:-1])
    o = o[new]
    if copies is not None:
        head = np.ones(len(o), bool)
        head[1:] = same[o][1:] != same[o][:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
        o = o[np.arange(len(o)) - first < copies]
    return ids[o], x[o]


def nearest(qi, qv, ci, cv, k: int):
    """(query ids, ids, scores) of the k best of each query in a block, ties to smaller ids."""
    qn, cn = np.sqrt((qv * qv).sum(1)), np.sqrt((cv * cv).sum(1))
    out_q, out_c, out_s = [], [], []
    unit = cv / cn[:, None]
    for lo in range(0, len(qi), 256):
        near = (qv[lo:lo + 256] / qn[lo:lo + 256, None]) @ unit.T
        for i in range(len(near)):
            row = near[i]
            row[ci == qi[lo + i]] = -np.inf
            cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            pick = np.flatnonzero((row >= cut - 1e-9) & (row > -np.inf))
            s = (cv[pick] * qv[lo + i]).sum(1) / (cn[pick] * qn[lo + i])
            o = np.lexsort((ci[pick], -s))[:k]
            out_q.append(np.full(len(o), qi[lo + i]))
            out_c.append(ci[pick][o])
            out_s.append(s[o])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, float)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the 5 nearest found of every row whose vec_id is divisible by 50, among all rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(spark, table, table.filter(F.col("vec_id") % 50 == 0))
