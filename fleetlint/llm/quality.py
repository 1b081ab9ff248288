"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors.

A logistic classifier (numpy) over shape statistics of the whole text gives
each document's evidence ``p``.  It is fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS``; their statistics, not their texts, reach the driver); evidence, counts and all priors are computed from every row.

Sites are a hierarchy: global, host, path.  A host's posterior mean shrinks
the mean evidence of its documents toward the global mean, a path's toward its
host's posterior; the shrinkage strengths are beta prior sizes estimated from
the spread of the group means (method of moments) by grouped aggregation.
The final log-odds add to the document's own evidence what its site says, the
document itself left out: ``logit(p) + logit(site) - logit(global)``.

Defined cases: null and empty texts have the statistics of an empty text; a
null host or path is a site of its own; without labels of both classes the
evidence is the smoothed share of label 1; a null doc_id never trains; several
labels of one document count as the smallest; repeated rows each count; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import written
from .textops import byte_table, column_bytes, map_text, split_words, word_hashes

SAMPLE_ROWS = 6000
MOST = 1e6                       # largest prior size: groups that do not differ at all
#: site tables up to this many rows are broadcast, larger ones joined by shuffle
BROADCAST_SITES = 100_000
NOT_BLANK = byte_table(lambda b: b not in (9, 10, 11, 12, 13, 32))
LINE = byte_table(lambda b: b != 10)


def _classes() -> np.ndarray:
    """Byte classes: 0 lower-case, 1 capital, 2 digit, 3 blank, 4 line feed, 5 sentence mark, 6 other ASCII, 7 non-ASCII."""
    c = np.full(256, 6, np.uint8)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[9, 11, 12, 13, 32]] = 3
    c[10] = 4
    c[[ord(x) for x in ".,;:!?'\"-()"]] = 5
    c[128:] = 7
    return c


_CLASS = _classes()
N_FEATURES = 14


def features(col: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    data, off = column_bytes(col)
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    shout = np.bincount(row, data == ord("!"), n) if len(data) else np.zeros(n)
    total = np.maximum(size, 1)[:, None]
    out = [np.log1p(size), *(count / total).T, shout / total[:, 0]]
    for table in (NOT_BLANK, LINE):
        folded, s, e, rows = split_words(data, off, table)
        h = word_hashes(folded, s, e)
        r = np.repeat(np.arange(n), np.diff(rows))
        o = np.lexsort((h, r))
        new = np.ones(len(h), bool)
        new[1:] = (h[o][1:] != h[o][:-1]) | (r[o][1:] != r[o][:-1])
        many = np.maximum(np.diff(rows), 1)
        out.append(np.bincount(r[o], new, n) / many)              # share of distinct words, then lines
        out.append(np.log1p(np.bincount(r, e - s, n) / many))     # mean length
    return np.stack(out, 1)


def fit(x: np.ndarray, y: np.ndarray, share: tuple[float, float] = (1.0, 1.0)) -> dict:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return {"constant": (pos + 0.5) / (len(y) + 1)}
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = _expand(x, mean, sd)
    w = np.zeros(z.shape[1])
    weight = np.where(y == 1, 1 / share[0], 1 / share[1])
    weight = weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.5 * w
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return {"mean": mean, "sd": sd, "w": w}


def _expand(x, mean, sd):
    z = np.clip((x - mean) / sd, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, z * z / 4])


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(_expand(x, model["mean"], model["sd"]) @ model["w"], -8, 8)))


def train(docs: DataFrame, labels: DataFrame, held_out=None) -> dict:
    """Classifier from a sample of labelled rows: the first by hashed doc_id, half of them per class.

    ``held_out``: optional column condition on labels; such rows never train.
    """
    ok = F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
    if held_out is not None:
        ok = ok & ~held_out
    one = labels.filter(ok).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    count = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    ids = [(r["doc_id"], r["quality"]) for q in (0, 1) for r in
           one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS // 2).collect()]
    if not ids:
        return {"constant": 0.5}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int"))
    got = (map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").dropDuplicates(["doc_id"]), "text", ["quality"],
                    [T.StructField("x", T.ArrayType(T.DoubleType()))], _feature_kernel).collect())      # numbers only, no texts
    y = np.array([r["quality"] for r in got], int)
    x = np.array([r["x"] for r in got], float).reshape(len(y), N_FEATURES)
    share = tuple(max(1, int((y == q).sum())) / max(1, count.get(q, 0)) for q in (1, 0))
    return fit(x, y, share)


def _feature_kernel(col: pa.Array) -> list[pa.Array]:
    x = features(col)
    return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.reshape(-1)))]


@dataclass(frozen=True)
class Sites:
    host: str = "host"
    path: str = "path"


def _logit(c):
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, center, center_name: str | None = None):
    """Beta prior size from (n, sum) groups: center's variance over the groups' variance beyond sampling."""
    m = F.col("s") / F.col("n")
    mu = F.col(center_name) if center_name else F.lit(center)
    r = groups.agg(F.sum(F.col("n") * (m - mu) * (m - mu)).alias("between"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                   F.count("*").alias("k"), F.sum("v").alias("v"), F.sum(F.col("n") * mu * (1 - mu)).alias("spread")).first()
    if not r["n"] or r["k"] < 2:
        return MOST
    within = r["v"] / r["n"]                                   # mean variance of evidence inside groups
    between = (r["between"] - r["k"] * within) / max(1.0, r["n"] - r["n2"] / r["n"])
    return float(min(MOST, max(1.0, (r["spread"] / r["n"]) / between - 1))) if between > 0 else MOST


def combine(scored: DataFrame, sites: Sites = Sites()) -> DataFrame:
    """``scored`` (evidence column ``p``, host and path columns) plus host_post, path_post and quality
    (columns of these names are replaced)."""
    h, p = f"`{sites.host}`", f"`{sites.path}`"
    made = ("host_post", "path_post", "quality")
    keep = [c for c in scored.columns if c not in made]
    flat = scored.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("p").alias("p"),
                         F.coalesce(F.concat(F.lit("s"), F.col(h).cast("string")), F.lit("n")).alias("_h"),
                         F.coalesce(F.concat(F.lit("s"), F.col(p).cast("string")), F.lit("n")).alias("_p"))
    paths = written(flat.groupBy("_h", "_p").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
                    .withColumn("v", F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))), "paths")
    hosts = paths.groupBy("_h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn(
        "v", F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")))
    r = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = r["s"] / r["n"] if r["n"] else 0.5
    k_host = _strength(hosts, "s", mu)
    hosts = hosts.select("_h", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + k_host * mu) / (F.col("n") + k_host)).alias("host_post"))
    table = written(paths.join(hosts, "_h"), "sites")
    k_path = _strength(table, "s", None, "host_post")
    few = table.count() <= BROADCAST_SITES
    site = table.select("_h", "_p", "n", "s", "hn", "hs")
    out = flat.join(F.broadcast(site) if few else site, ["_h", "_p"])
    own_host = (F.col("hs") - F.col("p") + k_host * mu) / (F.col("hn") - 1 + k_host)
    own_path = (F.col("s") - F.col("p") + k_path * own_host) / (F.col("n") - 1 + k_path)
    out = out.withColumn("host_post", own_host).withColumn("path_post", own_path)
    z = _logit(F.col("p")) + _logit(F.col("path_post")) - _logit(F.lit(mu))
    return out.withColumn("quality", 1 / (1 + F.exp(-z))).select("_row.*", "host_post", "path_post", "quality")


def score(spark: SparkSession, docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus the evidence ``p`` of every row."""
    shared = spark.sparkContext.broadcast(model)

    def kernel(col: pa.Array) -> list[pa.Array]:
        return [pa.array(evidence(shared.value, features(col)))]

    return map_text(docs, text, keep, [T.StructField("p", T.DoubleType())], kernel)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, evidence, host_post, path_post, quality, keep for every document; host = source, path = source and lang."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = written(score(spark, docs, model, ["doc_id", "host", "path"]), "evidence")
    out = combine(scored)
    return out.select("doc_id", F.col("p").alias("evidence"), "host_post", "path_post", "quality", (F.col("quality") >= 0.5).alias("keep"))
