"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are the words of the text (runs of letters, digits and non-ASCII
characters, A-Z lowered).  The ``TOP`` most frequent words of the whole corpus
have an id each, every other word the id of its hash bucket (``TAIL`` buckets).
The network predicts each token from the ``SIDE`` tokens before and after it
(position-wise embeddings, one hidden layer) through a two-level softmax
(class, member), so every probability is normalised over all ids.  A word of a
bucket has its share of the bucket's probability, ``(n + SMOOTH) / (N + SMOOTH *
(V + 1))`` by corpus counts (n of the word, N and V: tokens and distinct words of
the bucket; n is 0 for all words not in the corpus, which share one place).  The
counts of all words stay in a table that is joined with the documents' distinct
bucket words.  A document's score is the sum of the conditional log-probabilities
of all its tokens.

Training covers the whole corpus: every task walks all its rows, trains on every
position of every text with the full context, and returns its weights; they are averaged by positions seen, ``ROUNDS`` times.  What is
gathered (word counts, weights per task) grows with the input; the model
(about 0.5 MB, whatever the corpus) is broadcast.  Biases start from corpus
counts.

Defined cases: null and empty texts have no tokens, logp 0 and a null
mean; fewer words than a window are padded with a boundary token; repeated
rows count as often as they occur and are scored alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import written
from .textops import ALNUM, column_bytes, map_text, row_chunks, small_batches, split_words, word_hashes

MEMBERS = 32
TOP = 48 * MEMBERS
TAIL = 16 * MEMBERS
IDS = TOP + TAIL
CLASSES = IDS // MEMBERS
SIDE = 3
EMBED = 16
HIDDEN = 32
STRIDE = 1           # every position is a training target
#: positions a step, and from how many positions seen by the task on
STEPS = ((256, 0), (2048, 1 << 17))
ROUNDS = 2
SMOOTH = 0.5
OFFSETS = [j for j in range(-SIDE, SIDE + 1) if j]


def counts_of(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of every distinct word of the corpus, combined per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns, size = [], [], 0

        def merged():
            h, back = np.unique(np.concatenate(hs), return_inverse=True)
            return h, np.bincount(back.reshape(-1), np.concatenate(ns)).astype(np.int64)

        for b in batches:
            _, off = column_bytes(b.column(0))
            for lo, hi in row_chunks(off):
                folded, s, e, _ = split_words(*column_bytes(b.column(0).slice(lo, hi - lo)), ALNUM)
                h, n = np.unique(word_hashes(folded, s, e), return_counts=True)
                hs.append(h)
                ns.append(n)
                size += len(h)
                if size > 4_000_000:
                    h, n = merged()
                    hs, ns, size = [h], [n], len(h)
                    if size > 3_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                        hs, ns, size = [], [], 0
        if hs:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """(hash of each of the TOP ids, by frequency; corpus count of every id; distinct words of each
    bucket; the written table (h, n) of all words)."""
    words = written(counts_of(docs), "words")
    top = words.orderBy(F.desc("n"), "h").limit(TOP)
    rows = top.collect()
    h = np.array([r["h"] for r in rows], np.int64)
    n = np.zeros(IDS)
    n[:len(rows)] = [r["n"] for r in rows]
    bucket = F.pmod(F.shiftright("h", 7), F.lit(TAIL)).cast("int")
    distinct = np.zeros(TAIL)
    tail = words.join(F.broadcast(top.select("h")), "h", "left_anti").groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in tail.collect():                       # at most TAIL rows
        n[TOP + r["b"]], distinct[r["b"]] = r["n"], r["v"]
    return h, n, distinct, words


def start(n: np.ndarray, seed: int = 3) -> dict:
    """Untrained weights whose output is the corpus' unigram distribution."""
    rng = np.random.default_rng(seed)
    p = ((n + 0.5) / (n + 0.5).sum()).reshape(CLASSES, MEMBERS)
    return {"e": rng.normal(0, 0.3, (IDS + 1, EMBED)), "w": rng.normal(0, 1 / np.sqrt(EMBED * len(OFFSETS)), (len(OFFSETS), EMBED, HIDDEN)),
            "b": np.zeros(HIDDEN), "c": np.zeros((HIDDEN, CLASSES)), "cb": np.log(p.sum(1)),
            "m": np.zeros((CLASSES, HIDDEN, MEMBERS)), "mb": np.log(p / p.sum(1, keepdims=True))}


def ids_of(col: pa.Array, order: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids laid out with SIDE boundary tokens around every row, place of every token, tokens before each row)."""
    return _hashed_ids(col, order, top)[:3]


def _hashed_ids(col: pa.Array, order: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids_of`` and every token's word hash."""
    folded, s, e, rows = split_words(*column_bytes(col), ALNUM)
    h = word_hashes(folded, s, e).view(np.int64)
    place = np.searchsorted(top, h)
    place[place == len(top)] = 0
    known = top[place] == h if len(top) else np.zeros(len(h), bool)
    ids = np.where(known, order[place] if len(top) else 0, TOP + (h >> 7) % TAIL).astype(np.int32)
    n = len(rows) - 1
    out = np.full(int(rows[-1]) + SIDE * (n + 1), IDS, np.int32)
    at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(n), np.diff(rows)) + 1)
    out[at] = ids
    return out, at, rows, h


def _log_softmax(z):
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def log_probs(model: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Conditional log-probability of the tokens at ``at``, given both sides."""
    out = np.empty(len(at), np.float64)
    tables = model["tables"]
    for lo in range(0, len(at), 50_000):
        p = at[lo:lo + 50_000]
        a = model["b"] + tables[0][ids[p + OFFSETS[0]]]
        for t, j in zip(tables[1:], OFFSETS[1:]):
            a += t[ids[p + j]]
        h = np.tanh(a)
        y = ids[p]
        k, r = y // MEMBERS, y % MEMBERS
        o = np.argsort(k, kind="stable")
        h, k, r = h[o], k[o], r[o]
        z = h @ model["c"] + model["cb"]
        lp = z[np.arange(len(z)), k] - _lse(z)
        edge = np.searchsorted(k, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            i = slice(edge[c], edge[c + 1])
            if edge[c] < edge[c + 1]:
                z = h[i] @ model["m"][c] + model["mb"][c]
                lp[i] += z[np.arange(len(z)), r[i]] - _lse(z)
        back = np.empty(len(o))
        back[o] = lp
        out[lo:lo + 50_000] = back
    return out


def _lse(z):
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def ready(m: dict) -> dict:
    """Single-precision weights with the embedding and window products folded into one table per offset."""
    r = {k: np.asarray(v, np.float32) for k, v in m.items()}
    r["tables"] = [r["e"] @ w for w in r["w"]]
    return r


class Trainer:
    """Adagrad over minibatches of positions, from given weights."""

    def __init__(self, m: dict, rate: float = 0.08):
        self.m = {k: np.array(v, np.float32) for k, v in m.items()}
        self.acc = {k: np.full(v.shape, 0.1, np.float32) for k, v in self.m.items()}
        self.rate, self.seen = rate, 0

    def step(self, ctx: np.ndarray, y: np.ndarray) -> None:
        m, n = self.m, len(y)
        self.seen += n
        o = np.argsort(y, kind="stable")                           # by class
        ctx, y = ctx[o], y[o]
        k, r = y // MEMBERS, y % MEMBERS
        x = m["e"][ctx].reshape(n, -1)                             # (n, offsets * EMBED)
        w = m["w"].reshape(-1, HIDDEN)
        h = np.tanh(x @ w + m["b"])
        pc = np.exp(_log_softmax(h @ m["c"] + m["cb"]))
        pc[np.arange(n), k] -= 1
        pc /= n
        dh = pc @ m["c"].T
        edge = np.searchsorted(k, np.arange(CLASSES + 1))
        for c in np.flatnonzero(edge[1:] > edge[:-1]):
            i = slice(edge[c], edge[c + 1])
            pm = np.exp(_log_softmax(h[i] @ m["m"][c] + m["mb"][c]))
            pm[np.arange(len(pm)), r[i]] -= 1
            pm /= n
            dh[i] += pm @ m["m"][c].T
            self._move("m", h[i].T @ pm, c)
            self._move("mb", pm.sum(0), c)
        da = dh * (1 - h * h)
        dx = (da @ w.T).reshape(-1, EMBED)
        self._move("c", h.T @ pc)
        self._move("cb", pc.sum(0))
        self._move("w", (x.T @ da).reshape(m["w"].shape))
        self._move("b", da.sum(0))
        at = ctx.reshape(-1)
        self._move("e", np.stack([np.bincount(at, dx[:, j], IDS + 1) for j in range(EMBED)], 1).astype(np.float32))

    def _move(self, key, g, at=slice(None)):
        self.acc[key][at] += g * g
        self.m[key][at] -= self.rate * g / np.sqrt(self.acc[key][at])


def _flat(m: dict) -> np.ndarray:
    return np.concatenate([np.asarray(m[k], np.float32).reshape(-1) for k in sorted(m)])


def _shaped(v: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = np.size(like[k])
        out[k] = v[at:at + n].reshape(np.shape(like[k])).astype(float)
        at += n
    return out


PARTS = 16


def train(spark: SparkSession, docs: DataFrame) -> dict | None:
    """The averaged network and its vocabulary; None for a corpus without words."""
    top, n, distinct, words = vocabulary(docs)
    if n.sum() == 0:
        return None
    by_hash = np.argsort(top, kind="stable")
    order, top_sorted = by_hash, top[by_hash]
    model = start(n)
    texts = docs.select("text")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, order, top_sorted))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, o, t = shared.value
            trainer = Trainer(m)
            for b in batches:
                _, off = column_bytes(b.column(0))
                for lo, hi in row_chunks(off):
                    ids, at, _ = ids_of(b.column(0).slice(lo, hi - lo), o, t)
                    p = at[::STRIDE]
                    i = 0
                    while i < len(p):
                        size = max(n for n, seen in STEPS if trainer.seen >= seen)
                        q = p[i:i + size]
                        trainer.step(ids[q[:, None] + np.array(OFFSETS)], ids[q])
                        i += size
            if trainer.seen:
                v = np.array_split(_flat(trainer.m) * np.float32(trainer.seen), PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array([trainer.seen] * PARTS, pa.int64()),
                                                  pa.array([x.astype(np.float32).tobytes() for x in v], pa.binary())], names=["part", "seen", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                for p, s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    x = np.frombuffer(w.as_buffer(), np.float32).astype(float)
                    have = total.get(p)
                    total[p] = [s, x] if have is None else [have[0] + s, have[1] + x]
            for p, (s, x) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([s], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["part", "seen", "w"])

        schema = "part int, seen long, w binary"
        rows = texts.mapInArrow(local, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()   # PARTS rows
        if not rows:
            break
        rows.sort(key=lambda r: r["part"])
        model = _shaped(np.concatenate([np.frombuffer(r["w"], float) / r["seen"] for r in rows]), model)
    return {"model": model, "order": order, "top": top_sorted, "bucket": n[TOP:] + SMOOTH * (distinct + 1), "words": words}


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("logp", T.DoubleType())]


_TAIL_FIELDS = [T.StructField("_tail_h", T.ArrayType(T.LongType())), T.StructField("_tail_c", T.ArrayType(T.LongType()))]


def score(spark: SparkSession, docs: DataFrame, trained: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus n_tokens and logp (natural logarithm) of every row.

    The network's part is written once with each row's distinct bucket words; their counts are
    joined from the table of all words and summed by row."""
    if trained is None:
        def empty(col: pa.Array) -> list[pa.Array]:
            return [pa.array(np.zeros(len(col), np.int64)), pa.array(np.zeros(len(col)))]

        return map_text(docs, text, keep, FIELDS, empty)
    shared = spark.sparkContext.broadcast((ready(trained["model"]), trained["order"], trained["top"], np.log(trained["bucket"])))

    def kernel(col: pa.Array) -> list[pa.Array]:
        m, o, t, bucket = shared.value
        ids, at, rows, h = _hashed_ids(col, o, t)
        own = ids[at]
        in_bucket = own >= TOP
        lp = log_probs(m, ids, at)
        lp[in_bucket] -= bucket[own[in_bucket] - TOP]
        total = np.concatenate([[0.0], np.cumsum(lp)])
        row, word = np.repeat(np.arange(len(col)), np.diff(rows))[in_bucket], h[in_bucket]
        s = np.lexsort((word, row))
        row, word = row[s], word[s]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])]) if len(row) else np.zeros(0, np.int64)
        edge = pa.array(np.searchsorted(row[new], np.arange(len(col) + 1)), pa.int32())
        times = np.diff(np.r_[new, len(row)])
        return [pa.array(np.diff(rows), pa.int64()), pa.array(total[rows[1:]] - total[rows[:-1]], pa.float64()),
                pa.ListArray.from_arrays(edge, pa.array(word[new], pa.int64())), pa.ListArray.from_arrays(edge, pa.array(times, pa.int64()))]

    made = map_text(docs, text, keep, FIELDS + _TAIL_FIELDS, kernel)
    made = written(made.withColumn("_row", F.monotonically_increasing_id()), "scored")
    tail = made.select("_row", F.explode(F.arrays_zip("_tail_h", "_tail_c")).alias("x")).select("_row", F.col("x._tail_h").alias("h"), F.col("x._tail_c").alias("c"))
    part = (tail.join(trained["words"], "h", "left")
                .groupBy("_row").agg(F.sum(F.col("c") * F.log(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("_part")))
    names = [c for c in made.columns if c not in ("_row", "_tail_h", "_tail_c")]
    out = made.select("_row", *[F.col(f"`{c}`") for c in names]).join(part, "_row", "left")
    return out.select(*[(F.col("logp") + F.coalesce("_part", F.lit(0.0))).alias(c) if c == "logp" else F.col(f"`{c}`") for c in names])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, logp, mean_logp and perplexity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(spark, docs, train(spark, docs), ["doc_id"])
    mean = F.when(F.col("n_tokens") > 0, F.col("logp") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "logp", mean.alias("mean_logp"), F.exp(-mean).alias("perplexity"))
