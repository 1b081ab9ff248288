"""Convolutional text classifier for toxicity, trained in numpy.

Words (runs of letters, digits and non-ASCII characters, A-Z lowered) are
hashed twice; a word's vector is the two hashed halves side by side.  Filters
of several widths slide over each whole text, max pooling keeps each filter's
strongest response and a logistic layer gives the score.  Halves start from
smoothed log-odds of their buckets and are then trained by gradient descent.

Training covers every labelled row that is not held out: three fourths fit the
network, the fourth held back calibrates the thresholds by language; the
language never enters a score.  Bucket counts are added up over all these rows,
then every task (of ``TASK_ROWS`` rows or more) trains the common weights on its
own rows, and the weights are averaged by rows seen, ``ROUNDS`` times.  A task holds ``WORDS`` words (or one text) and one model; the
driver gets the model (4 MB, fixed by ``BUCKETS``), counts of that size, and the
thresholds.

Defined cases: null and empty texts have no words and get the score of an
empty text; without labels of both classes the score of every text is the
smoothed positive rate ``(pos + 0.5) / (n + 2)``; a null doc_id is not held out
and never trains; several labels of one document count as the largest, of
several texts of one doc_id the smallest (text, lang) trains; repeated rows are
scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import written
from .textops import ALNUM, column_bytes, fresh, give_back, map_text, row_chunks, small_batches, split_words, word_hashes

BUCKETS = 1 << 16
HALF = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS)
BATCH = 32
STEPS = 600
LEAK = 0.05                     # slope of a unit below zero: no unit stops learning
RATE = 0.05
ROUNDS = 2                      # averagings of the tasks' weights
TASK_ROWS = 4096                # smaller tables are trained in so few tasks that each has about so many labelled rows
WORDS = 500_000                 # words that a task trains on at a time, and at most (or one text) in a step
#: classes are weighted as if there were at most so many rows of each
BALANCE = {1: 1200, 0: 2400}
#: rows of each class that a calibration needs, the range of calibrated thresholds, and the score steps they are found in
CALIBRATE = 10
CUTS = (0.2, 0.8)
GRID = 10_000


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bucket numbers per word and the first word of each row."""
    data, off = column_bytes(col)
    folded, s, e, rows = split_words(data, off, ALNUM)
    h = word_hashes(folded, s, e)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32), ((h >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int32), rows


def _padded(h1, h2, rows):
    """Rows laid out with PAD empty places after each; (buckets, segment starts, segment ends).

    A segment is a row's words and one empty place, so no window of a segment
    reaches the next row, and a row without words has a window, too.
    """
    n = len(rows) - 1
    place = np.arange(rows[-1]) + PAD * np.repeat(np.arange(n), np.diff(rows))
    size = int(rows[-1]) + PAD * n
    a = np.full(size, BUCKETS, np.int32)
    b = np.full(size, BUCKETS, np.int32)
    a[place], b[place] = h1, h2
    first = rows[:-1] + PAD * np.arange(n)
    return a, b, first, first + np.diff(rows) + 1


def _responses(model, a, b):
    """Filter responses at every place, one array per width (places past the end are empty)."""
    x = np.hstack([model["e1"][a], model["e2"][b]])
    out = []
    for w in WIDTHS:
        k = model[f"w{w}"]                       # (w, 2*HALF, FILTERS)
        z = x @ k[0]
        for j in range(1, w):
            z[:-j] += x[j:] @ k[j]
        out.append(z)
    return out


def _unit(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, LEAK * z)


def score_tokens(model: dict, h1, h2, rows) -> np.ndarray:
    n = len(rows) - 1
    if n == 0:
        return np.zeros(0)
    if "constant" in model:
        return np.full(n, model["constant"])
    pooled = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
    lo = 0
    while lo < n:                                # about 60,000 words at a time
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + 60_000, side="right")) - 1)
        a, b, first, last = _padded(h1[rows[lo]:rows[hi]], h2[rows[lo]:rows[hi]], rows[lo:hi + 1] - rows[lo])
        cuts = np.stack([first, last], 1).reshape(-1)
        pooled[lo:hi] = np.hstack([np.maximum.reduceat(z, cuts, axis=0)[::2] for z in _responses(model, a, b)])
        lo = hi
    hidden = _unit(pooled + model["b"]).astype(np.float64)
    z = np.clip(hidden @ model["v"] + model["c"], -30, 30)
    return 1 / (1 + np.exp(-z))


def start(df: list[np.ndarray], pos: int, neg: int, seed: int = 7) -> dict:
    """Weights before training, from ``df``: rows of each class that hold a bucket, a (2, BUCKETS) array per half."""
    rng = np.random.default_rng(seed)
    m: dict = {}
    for d, name in zip(df, ("e1", "e2")):
        a = 5 * np.sqrt(min(pos, BALANCE[1]) / BALANCE[1])      # smoothing grows with the smaller class, slower than its rows
        odds = np.log((d[1] + a) / (pos + 2 * a)) - np.log((d[0] + a) / (neg + 2 * a))
        odds -= np.log(a / (pos + 2 * a)) - np.log(a / (neg + 2 * a))
        e = rng.normal(0, 0.05, (BUCKETS + 1, HALF))
        e[:-1, 0] = np.clip(odds, -4, 4) / 4
        e[-1] = 0
        m[name] = e.astype(np.float32)
    for w in WIDTHS:
        k = rng.normal(0, 0.1, (w, 2 * HALF, FILTERS))
        k[0, [0, HALF], :FILTERS // 2] = 1.0
        m[f"w{w}"] = k.astype(np.float32)
    nf = FILTERS * len(WIDTHS)
    m["b"] = np.full(nf, -0.6, np.float32)
    m["v"] = np.tile(np.r_[np.full(FILTERS // 2, 1.0), rng.normal(0, 0.1, FILTERS - FILTERS // 2)], len(WIDTHS))
    m["c"] = -1.0
    return m


def class_weight(pos: int, neg: int) -> float:
    """Weight of a row of class 1, where one of class 0 has 1."""
    return min(1.0, BALANCE[1] / pos) / min(1.0, BALANCE[0] / neg)


def present(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> list[np.ndarray]:
    """Rows of each class that hold a bucket, for both halves."""
    df = [np.zeros((2, BUCKETS)) for _ in range(2)]
    for d, label in zip(docs, y):
        for half in (0, 1):
            df[half][label, np.unique(d[half])] += 1
    return df


class Trainer:
    """Adagrad over minibatches of rows, from given weights; rows of class 1 count ``weight`` times."""

    def __init__(self, m: dict, weight: float, rate: float = RATE, seed: int = 7):
        self.m = {k: np.array(v, np.float32) if np.ndim(v) else float(v) for k, v in m.items()}
        self.acc = {k: np.full(np.shape(v), 1e-4, np.float32) for k, v in m.items()}
        self.weight, self.rate, self.seen = weight, rate, 0
        self.rng = np.random.default_rng(seed)

    def _move(self, key, grad, at=None):
        m, acc, rate = self.m, self.acc, self.rate
        if at is None:
            acc[key] = acc[key] + grad * grad
            m[key] = (m[key] - rate * grad / np.sqrt(acc[key])).astype(np.float32) if np.ndim(m[key]) else float(m[key] - rate * grad / np.sqrt(acc[key]))
        else:
            rows, back = np.unique(at, return_inverse=True)
            g = np.zeros((len(rows), grad.shape[1]))
            np.add.at(g, back, grad)
            live = rows != BUCKETS
            rows, g = rows[live], g[live]
            acc[key][rows] += g * g
            m[key][rows] -= (rate * g / np.sqrt(acc[key][rows])).astype(np.float32)

    def walk(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int) -> None:
        """``passes`` times over these rows, in steps of BATCH rows and at most WORDS words (or one row)."""
        self.seen += len(docs)
        size = np.array([len(d[0]) for d in docs])
        order = np.arange(len(docs))
        for _ in range(passes):
            self.rng.shuffle(order)
            lo = 0
            while lo < len(order):
                fits = int(np.searchsorted(np.cumsum(size[order[lo:lo + BATCH]]), WORDS, side="right"))
                pick = order[lo:lo + max(1, fits)]
                self.step([docs[i] for i in pick], y[pick])
                lo += len(pick)

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        m = self.m
        rows = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
        a, b, first, last = _padded(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), rows)
        where, pooled = [], []
        for z in _responses(m, a, b):
            arg = np.array([s + z[s:e].argmax(0) for s, e in zip(first, last)])
            where.append(arg)
            pooled.append(np.take_along_axis(z, arg, 0))
        pre = np.hstack(pooled) + m["b"]
        hid = _unit(pre)
        p = 1 / (1 + np.exp(-np.clip(hid @ m["v"] + m["c"], -30, 30)))
        err = (p - y) * np.where(y == 1, self.weight, 1.0) / len(docs)
        dv, dc = hid.T @ err + 1e-4 * m["v"], float(err.sum())
        dh = err[:, None] * m["v"][None, :] * np.where(pre > 0, 1, LEAK)
        g1, g2, rows_at = [], [], []
        for wi, w in enumerate(WIDTHS):
            d = dh[:, wi * FILTERS:(wi + 1) * FILTERS]
            k = m[f"w{w}"]
            dk = np.zeros(k.shape)
            for j in range(w):
                at = where[wi] + j
                ok = at < len(a)
                at = np.where(ok, at, 0)
                dd = d * ok
                x = np.concatenate([m["e1"][a[at]], m["e2"][b[at]]], axis=2)   # (docs, FILTERS, 2*HALF)
                dk[j] = np.einsum("df,dfe->ef", dd, x)
                gx = dd[:, :, None] * k[j].T[None, :, :]
                g1.append(gx[:, :, :HALF].reshape(-1, HALF))
                g2.append(gx[:, :, HALF:].reshape(-1, HALF))
                rows_at.append(at.reshape(-1))
            self._move(f"w{w}", dk)
        flat = np.concatenate(rows_at)
        self._move("e1", np.concatenate(g1), at=a[flat])
        self._move("e2", np.concatenate(g2), at=b[flat])
        self._move("b", dh.sum(0))
        self._move("v", dv)
        self._move("c", dc)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> dict:
    """Train in one place on (bucket, bucket) word arrays and 0/1 labels."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return {"constant": (pos + 0.5) / (len(y) + 2)}
    weight = class_weight(pos, neg)
    t = Trainer(start(present(docs, y), pos, neg, seed), weight, seed=seed)
    t.walk(docs, y, passes(len(docs), 1))
    return finished(t.m, weight)


def passes(rows: float, rounds: int) -> int:
    """Passes of a round over the rows of a task: about STEPS steps in all, of few rows at most 40 passes, of many 2 a round."""
    return int(min(40 // rounds, max(2, STEPS * BATCH // (rounds * max(1, rows)))))


def finished(m: dict, weight: float) -> dict:
    """The weights that score: the class weights are undone."""
    return m | {"v": np.asarray(m["v"], np.float64), "c": float(m["c"] - np.log(weight))}


def thresholds(scored: DataFrame) -> dict:
    """Cut of largest F1 by language and, under None, of all rows, from rows (lang, toxic, score).

    Rows are counted by steps of 1 / GRID of the score; a cut lies midway between a step that
    has rows and the next lower one that has, and is kept within CUTS.  A language with fewer
    than CALIBRATE rows of a class has no cut of its own; the common one is 0.5 then."""
    step = F.least(F.floor(F.col("score") * GRID), F.lit(GRID - 1)).cast("int")
    both = F.explode(F.array(F.coalesce("lang", F.lit("")), F.lit(None).cast("string")))        # its language and all
    n = scored.select(both.alias("lang"), step.alias("step"), "toxic").groupBy("lang", "step").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    w = Window.partitionBy("lang")                    # at most GRID rows of a language
    down = w.orderBy(F.desc("step"))
    n = n.select("lang", "step", F.lead("step").over(down).alias("below"), F.sum("t").over(w).alias("pos"), F.sum("n").over(w).alias("all"),
                 F.sum("t").over(down).alias("tp"), F.sum("n").over(down).alias("flagged"))
    best = F.max_by(F.struct("step", "below"), F.struct((2 * F.col("tp") / (F.col("flagged") + F.col("pos"))).alias("f1"), "step"))
    rows = (n.filter((F.col("pos") >= CALIBRATE) & (F.col("all") - F.col("pos") >= CALIBRATE))
             .groupBy("lang").agg(best.alias("b")).collect())
    cuts = {r["lang"]: (r["b"]["step"] + (0 if r["b"]["below"] is None else r["b"]["below"] + 1)) / 2 / GRID for r in rows}
    cuts = {g: min(CUTS[1], max(CUTS[0], v)) for g, v in cuts.items()}
    return {None: 0.5} | cuts


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_BACK = 4                       # one of so many rows is held back for the thresholds


def _merged(df: DataFrame) -> dict[str, np.ndarray]:
    """Sum of the arrays (name, part, float32 bytes) that the tasks give, by name: added up by Spark, one part a group."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for name, part, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(v.as_buffer(), np.float32)
                have = total.get((name, part))
                total[name, part] = x.astype(float) if have is None else have + x
        for (name, part), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["name", "part", "v"])

    out: dict[str, list] = {}
    for r in df.repartition(_PARTS, "name", "part").mapInArrow(add, df.schema).collect():
        out.setdefault(r["name"], []).append((r["part"], np.frombuffer(r["v"], float)))
    return {name: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for name, v in out.items()}


_PARTS = 8
_SUM_SCHEMA = "name string, part int, v binary"


def _parts(name: str, x: np.ndarray) -> pa.RecordBatch:
    v = np.array_split(np.asarray(x, np.float32).reshape(-1), _PARTS)
    return pa.RecordBatch.from_arrays([pa.array([name] * _PARTS), pa.array(np.arange(_PARTS), pa.int32()), pa.array([i.tobytes() for i in v], pa.binary())],
                                      names=["name", "part", "v"])


def _buffers(batches: Iterator[pa.RecordBatch]):
    """(word arrays, labels) of rows (toxic, text), about WORDS words (or one row) at a time."""
    docs, y, size = [], [], 0
    for b in batches:
        _, off = column_bytes(b.column(1))
        for lo, hi in row_chunks(off):
            h1, h2, rows = tokens(b.column(1).slice(lo, hi - lo))
            for i, label in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                docs.append((h1[rows[i]:rows[i + 1]], h2[rows[i]:rows[i + 1]]))
                y.append(label)
                size += int(rows[i + 1] - rows[i])
                if size > WORDS:
                    yield docs, np.array(y)
                    docs, y, size = [], [], 0
    if docs:
        yield docs, np.array(y)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row that is not held out, written once as (doc_id, lang, toxic, text, back), sorted by doc_id within
    its file.  ``back``: held back for the thresholds."""
    one = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
                 .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = texts.join(one, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    rows = rows.select("doc_id", "t.lang", "toxic", "t.text", (F.pmod(F.xxhash64("doc_id"), F.lit(_BACK)) == 0).alias("back"))
    return written(rows.sortWithinPartitions("doc_id"), "toxicity-rows")


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict]:
    """(model, thresholds by language; key None holds the common one) from all labelled rows that are not held out.

    A language gets its own threshold if the rows held back have CALIBRATE of each class in it, the
    common one is 0.5 if even all languages together have fewer."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    n = {r["toxic"]: r["n"] for r in rows.filter(~F.col("back")).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {"constant": (pos + 0.5) / (pos + neg + 2)}, {None: 0.5}
    fitted = rows.filter(~F.col("back")).select("toxic", "text").coalesce(-(-(pos + neg) // TASK_ROWS))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = [np.zeros((2, BUCKETS)) for _ in range(2)]
        seen = 0
        for d, y in _buffers(batches):
            seen += len(d)
            for have, x in zip(df, present(d, y)):
                have += x
        if seen:
            for half in (0, 1):
                yield _parts(f"df{half}", df[half])
            yield _parts("tasks", np.ones(_PARTS))
        give_back()

    df = _merged(fitted.mapInArrow(holding, _SUM_SCHEMA))
    model = start([df[f"df{half}"].reshape(2, BUCKETS) for half in (0, 1)], pos, neg)
    weight = class_weight(pos, neg)
    again = passes((pos + neg) / df["tasks"][0], ROUNDS)
    names = sorted(model)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rate = RATE / (k + 1)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value, weight, rate)
            for d, y in _buffers(batches):
                trainer.walk(d, y, again)
            if trainer.seen:
                for name in names:
                    yield _parts(name, np.asarray(trainer.m[name], float) * trainer.seen)
                yield _parts("rows", np.full(_PARTS, trainer.seen))
            trainer = None
            give_back()

        total = _merged(fitted.mapInArrow(local, _SUM_SCHEMA))
        model = {name: (total[name] / total["rows"][0]).astype(np.float32).reshape(np.shape(model[name])) for name in names}
        model["c"] = float(model["c"])
        shared.destroy()
    model = finished(model, weight)
    return model, thresholds(score(spark, rows.filter("back"), model, ["lang", "toxic"]))


def score(spark: SparkSession, docs: DataFrame, model: dict, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns of every row plus the score, as column ``name``; the model (a few MB, fixed by BUCKETS) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def kernel(col: pa.Array) -> list[pa.Array]:
        return [pa.array(score_tokens(shared.value, *tokens(col)), pa.float64())]

    return map_text(docs, text, keep, [T.StructField(name, T.DoubleType())], kernel)


def threshold_of(cuts: dict, lang: str = "lang"):
    """Column with the calibrated threshold of the row's language."""
    out = F.lit(float(cuts[None]))
    for g, v in cuts.items():
        if g is not None:
            out = F.when(F.coalesce(F.col(lang), F.lit("")) == g, F.lit(float(v))).otherwise(out)
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, held_out, score, predicted, and the calibrated decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, cuts = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(spark, docs.select("doc_id", "lang", "text"), model, ["doc_id", "lang"])
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      (F.col("score") >= threshold_of(cuts)).alias("flagged"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold (columns of documents)."""
    model, cuts = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cols = docs.columns
    name = fresh("score", cols)
    return score(spark, docs, model, cols, name=name).filter(F.col(name) < threshold_of(cuts)).select(*cols)
