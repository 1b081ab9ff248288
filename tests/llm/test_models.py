"""Search, scoring, classifiers and mixing: recall, held-out accuracy, exact measures, odd inputs."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlint.llm import ann, lmscore, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


# -- nearest neighbours ---------------------------------------------------------------------------

def brute_near(ids, x, q, k=5):
    n = np.sqrt((x * x).sum(1))
    s = (x * x[q]).sum(1) / (n * n[q])
    o = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in o]


def test_search_recall_with_clusters_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROOT", 3)
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.vstack([centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16)), np.tile(rng.normal(size=16), (1500, 1))])
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(spark, df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit, total = 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = brute_near(ids, x, q)
        mine = got[int(ids[q])]
        assert len(mine) == 5 and [m[1] for m in mine] == sorted((m[1] for m in mine), reverse=True)
        hit += len({i for i, _ in want} & {i for i, _ in mine})
        total += 5
    assert hit / total >= 0.9


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.search(spark, df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    h = round(math.sqrt(0.5), 12)
    assert got == [(0, 1, 1, h), (0, 2, 2, h), (0, 3, 50, 0.0), (50, 1, 1, h), (50, 2, 2, h), (50, 3, 0, 0.0)]
    assert ann.search(spark, df.limit(0), df.limit(0)).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = ann._unit(rng.normal(size=(1000, 8)))
    part = ann.balanced_parts(ann.neighbour_graph(x), 3)
    assert sorted(set(part)) == list(range(8)) and np.bincount(part).max() - np.bincount(part).min() <= 8


def test_search_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    got = collections.defaultdict(list)
    for r in ann.op3(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {int(ids[q]): brute_near(ids, x, q) for q in np.flatnonzero(ids % 50 == 0)}
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9


# -- pseudo-likelihood ----------------------------------------------------------------------------

def naive_logp(m, ids):
    """Log-probability of every token, one at a time, summed over all ids to check the normalisation."""
    out = []
    pad = [lmscore.IDS] * lmscore.SIDE
    seq = pad + list(ids) + pad
    for i, y in enumerate(ids):
        a = m["b"].copy()
        for w, j in zip(m["w"], lmscore.OFFSETS):
            a = a + m["e"][seq[i + lmscore.SIDE + j]] @ w
        h = np.tanh(a)
        pc = np.exp(h @ m["c"] + m["cb"])
        pc /= pc.sum()
        full = []
        for c in range(lmscore.CLASSES):
            z = np.exp(h @ m["m"][c] + m["mb"][c])
            full.append(pc[c] * z / z.sum())
        full = np.concatenate(full)
        assert abs(full.sum() - 1) < 1e-9
        out.append(math.log(full[y]))
    return out


def test_pseudo_likelihood_matches_naive():
    rng = np.random.default_rng(5)
    m = lmscore.start(rng.integers(0, 50, lmscore.IDS).astype(float))
    m["c"], m["m"] = rng.normal(0, 0.3, m["c"].shape), rng.normal(0, 0.3, m["m"].shape)
    words = [f"w{i}" for i in range(30)]
    texts = ["", None, "w1", " ".join(rng.choice(words, 40)), "w2 w3"]
    top = np.sort(rng.integers(-2**62, 2**62, 5))
    ids, at, rows = lmscore.ids_of(pa.array(texts), np.arange(5), top)
    lp = lmscore.log_probs(lmscore.ready(m), ids, at)
    for r in range(len(texts)):
        own = at[rows[r]:rows[r + 1]]
        assert np.allclose(lp[rows[r]:rows[r + 1]], naive_logp(m, ids[own]), atol=2e-3)


def test_training_learns_both_sides(spark, monkeypatch):
    """Words determined by their neighbours get likelier than by frequency alone; other order, lower score."""
    monkeypatch.setattr(lmscore, "STRIDE", 1)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(400):
        k = int(rng.integers(0, 40))
        rows.append((d, " ".join(words[(k + i) % 40] for i in range(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    trained = lmscore.train(spark, docs)
    mixed = " ".join(rng.permutation(rows[0][1].split()))
    test = spark.createDataFrame([(1, rows[0][1]), (2, mixed), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["logp"]) for r in lmscore.score(spark, test, trained, ["doc_id"]).collect()}
    assert got[3] == (0, 0.0) and got[4] == (0, 0.0)
    assert got[1][1] / 200 > -math.log(40) + 1.0 and got[1][1] > got[2][1] + 100


def test_training_learns_from_short_texts(spark):
    """With the production values, a corpus of texts of seven words is learned."""
    assert lmscore.STRIDE == 1
    rows = [(d, " ".join(f"w{(7 * d + i) % 40}" for i in range(7))) for d in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    trained = lmscore.train(spark, docs)
    test = spark.createDataFrame([(1, rows[0][1]), (2, " ".join(reversed(rows[0][1].split())))], "doc_id long, text string")
    got = {r["doc_id"]: r["logp"] for r in lmscore.score(spark, test, trained, ["doc_id"]).collect()}
    assert got[1] / 7 > -math.log(40) + 0.5 and got[1] > got[2] + 3


def test_bucket_words_have_their_own_share(spark, monkeypatch):
    """Beyond the vocabulary a word has its share of its bucket by its own count; never-seen words have the smoothed rest."""
    monkeypatch.setattr(lmscore, "ROUNDS", 0)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(lmscore.TOP)]
    rare = [f"r{i}" for i in range(2000)]
    texts = [" ".join(words)] * 40 + [" ".join(rng.permutation(rare))] + [" ".join(rare[:500])] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trained = lmscore.train(spark, docs)
    seen = collections.Counter(" ".join(texts).split())
    tests = ["r0", "r1999", "never", "r0 r0 never", "w1", ""] + rare
    test = spark.createDataFrame(list(enumerate(tests + tests[:1])), "doc_id long, text string").withColumn("doc_id", F.when(F.col("doc_id") < len(tests), F.col("doc_id")))
    got = {r["doc_id"]: r["logp"] for r in lmscore.score(spark, test, trained, ["doc_id"]).collect()}
    assert abs(got[None] - got[0]) < 1e-9 and got[5] == 0 and len(got) == len(tests) + 1
    # without training rounds the network gives the id's corpus share, so a word has count by count its own
    total = sum(seen.values()) + 0.5 * lmscore.IDS
    col = pa.array(tests)
    ids, at, rows = lmscore.ids_of(col, trained["order"], trained["top"])
    per_bucket, distinct = collections.Counter(), collections.Counter()
    for w, i in {t: ids[at[rows[k]]] for k, t in enumerate(tests) if t in seen}.items():
        if i >= lmscore.TOP:
            per_bucket[i] += seen[w]
            distinct[i] += 1
    for k in (0, 1, 2):
        i = ids[at[rows[k]]]
        want = math.log((per_bucket[i] + 0.5) / total) + math.log((seen[tests[k]] + 0.5) / (per_bucket[i] + 0.5 * (distinct[i] + 1)))
        assert abs(got[k] - want) < 1e-3
    assert got[0] > got[1] and abs(got[3] - 2 * got[0] - got[2]) < 1e-3


def test_scoring_odd(spark, odd_docs, no_docs):
    out = lmscore.score(spark, odd_docs, lmscore.train(spark, odd_docs), ["doc_id"]).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 0, 3, 3, 5, 5, 32000] and all(math.isfinite(r["logp"]) for r in out)
    assert lmscore.train(spark, no_docs) is None
    assert lmscore.score(spark, no_docs, None, ["doc_id"]).count() == 0


# -- classifiers ----------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    got = toxicity.op7(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert (test.predicted == test.toxic).mean() >= 0.9


def test_toxicity_score_ignores_everything_but_text(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, cuts = toxicity.train(docs, labels)
    a = toxicity.score(spark, docs, model, ["doc_id"]).toPandas().set_index("doc_id").score
    b = toxicity.score(spark, docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", -F.col("doc_id") - 1).repartition(3), model, ["doc_id"]).toPandas()
    b = b.assign(doc_id=-b.doc_id - 1).set_index("doc_id").score
    assert np.allclose(a.sort_index(), b.sort_index(), atol=2e-3)
    odd = toxicity.score(spark, odd_docs, model, odd_docs.columns)
    assert odd.count() == 8 and odd.filter("score between 0 and 1").count() == 8
    assert all(toxicity.CUTS[0] <= v <= toxicity.CUTS[1] for v in cuts.values())


def test_toxicity_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none) == ({"constant": 0.25}, {None: 0.5})
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 0), (3, 0, 7)], "doc_id long, quality int, toxic int")
    model, _ = toxicity.train(docs, odd)
    assert set(model) == {"constant"} and model["constant"] < 0.5


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, toxicity.held_out())
    both = quality.score(spark, docs, model, ["doc_id"]).toPandas().merge(labels.withColumn("h", toxicity.held_out()).toPandas(), on="doc_id")
    test = both[both.h]
    assert ((test.p >= 0.5) == (test.quality == 1)).mean() >= 0.95


def test_quality_shrinks_sparse_sites(spark):
    """A site of one bad page stays near the global mean; a large bad site does not."""
    rows = [(i, f"good{i % 30}", f"good{i % 30}/p", 0.9) for i in range(3000)] + [(5000 + i, "bad", f"bad/{i % 2}", 0.2) for i in range(400)]
    rows += [(9000, "tiny", "tiny/p", 0.2), (9001, None, None, 0.5), (9001, None, None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, p double").withColumn("quality", F.lit("x")).withColumn("n", F.lit("x"))
    got = {r["doc_id"]: r for r in quality.combine(df).collect()}
    assert got[5000]["path_post"] < 0.35 and got[0]["path_post"] > 0.85
    assert got[9000]["path_post"] > 0.6                       # nothing but itself speaks for the site
    assert got[5000]["quality"] < 0.1 < got[9000]["quality"]
    assert quality.combine(df).count() == len(rows)
    assert quality.combine(df.limit(0)).count() == 0


def test_quality_odd(spark, odd_docs, small):
    model = quality.train(odd_docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    out = quality.score(spark, odd_docs, model, ["doc_id", "p"])
    assert out.count() == 8 and out.filter("p between 0 and 1").count() == 8
    assert quality.op9(spark, small).count() == 200


# -- mixing ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sources(spark):
    """Ten sources, one with 60 % of the tokens."""
    rows, d = [], 0
    for s in range(10):
        for i in range(600 if s == 0 else 40 + 3 * s):
            rows.append((d, f"s{s}", "w " * (3 + (7 * i + s) % 11)))
            d += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=1.0), mixing.Target(entropy=1.0, repeats=1.5), mixing.Target(budget=500), mixing.Target(entropy=0.0)])
def test_mixing_budget_and_target(sources, target):
    docs = sources.toPandas()
    docs["n"] = docs.text.str.split().str.len()
    size = docs.groupby("source").n.sum()
    out = mixing.deal(sources, target).toPandas()
    out["n"] = out.text.str.split().str.len()
    weight = out.groupby("source").weight.first().reindex(size.index)
    assert abs(weight.sum() - 1) < 1e-9
    budget = target.budget or size.sum()
    h = -(weight * np.log(weight)).sum() / math.log(len(size))
    assert (weight * budget / size).max() <= target.repeats * (1 + 1e-6)
    if target.repeats >= 4:
        assert h >= target.entropy - 1e-6
    dealt = out.groupby("source").n.sum().reindex(size.index)
    goal = np.floor(weight * budget)
    assert ((dealt >= goal) & (dealt < goal + 14)).all()          # past the budget by less than one document
    for s, g in out.groupby("source"):
        last = g.epoch.max()
        for e, x in g.groupby("epoch"):
            assert x.doc_id.is_unique and (e == last or len(x) == (docs.source == s).sum())


def test_mixing_is_a_block_permutation(sources, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    out = mixing.deal(sources, mixing.Target(entropy=0.0)).toPandas()
    hot = out[(out.source == "s0") & (out.epoch == 0)].sort_values(["block_key", "doc_key"])
    assert hot.block.nunique() > 5
    assert (hot.block != hot.block.shift()).sum() == hot.block.nunique()          # blocks stay together
    assert hot.doc_id.tolist() != sorted(hot.doc_id)
    again = mixing.deal(sources.repartition(7), mixing.Target(entropy=0.0)).toPandas()
    assert sorted(map(tuple, out.drop(columns="text").round(12).itertuples(index=False))) == sorted(map(tuple, again.drop(columns="text").round(12).itertuples(index=False)))


def test_mixing_odd(spark, odd_docs, no_docs):
    out = mixing.deal(odd_docs).toPandas()
    assert not out.empty and out.weight.map(lambda w: isinstance(w, float)).all()
    assert mixing.deal(no_docs).count() == 0
    empty = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")
    assert mixing.deal(empty).count() == 0


def test_toxicity_scores_equal_a_plain_forward_pass():
    """Every window of every width scored on its own, the best of each filter kept, the units leaking below zero."""
    rng = np.random.default_rng(3)
    texts = ["", "Bad bad WORD 12 é", "a", "good fine nice day", "\n\t", "x " * 70000, "bad word good", "é漢 Bad", "fine day bad bad"]
    docs = [toxicity.tokens(pa.array([t], pa.large_string())) for t in texts]
    y = np.array([0, 1, 0, 0, 0, 0, 1, 1, 1])
    m = toxicity.fit([(d[0][:2000], d[1][:2000]) for d in docs], y)
    h1, h2, rows = toxicity.tokens(pa.array(texts, pa.large_string()))
    got = toxicity.score_tokens(m, h1, h2, rows)
    zero = np.full(2 * toxicity.HALF, 0.0)
    for (a, b, _), score in zip(docs, got):
        x = [np.concatenate([m["e1"][i], m["e2"][j]]) for i, j in zip(a, b)] if len(a) < 1000 else [np.concatenate([m["e1"][a[0]], m["e2"][b[0]]])] * 1000
        hidden = []
        for w in toxicity.WIDTHS:
            padded = x + [zero] * w
            z = [sum(padded[s + j] @ m[f"w{w}"][j] for j in range(w)) for s in range(len(x) + 1)]
            hidden += list(np.max(z, axis=0))
        pre = np.array(hidden) + m["b"]
        z = np.where(pre > 0, pre, toxicity.LEAK * pre) @ m["v"] + m["c"]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4
    assert got.max() - got.min() > 0.3


def test_quality_posteriors_equal_a_plain_version(spark):
    """Means and prior sizes of hosts and paths in plain Python, each document left out of its own site."""
    rng = np.random.default_rng(4)
    rows = []
    for h in range(12):
        base = rng.beta(2, 2)
        for p in range(rng.integers(1, 5)):
            share = np.clip(base + rng.normal(0, 0.15), 0.05, 0.95)
            rows += [(len(rows) + i, None if h == 3 else f"h{h}", None if p == 2 else f"p{p}", float(rng.beta(8 * share, 8 * (1 - share)))) for i in range(rng.integers(1, 30))]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]

    def strength(groups, centers):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (np.mean(g) - c) ** 2 for g, c in zip(groups, centers))
        within = sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups) / n
        between = (between - len(groups) * within) / max(1, n - sum(len(g) ** 2 for g in groups) / n)
        spread = sum(len(g) * c * (1 - c) for g, c in zip(groups, centers)) / n
        return min(quality.MOST, max(1, spread / between - 1)) if between > 0 else quality.MOST

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for _, h, p, v in rows:
        hosts[h].append(v)
        paths[(h, p)].append(v)
    mu = np.mean([r[3] for r in rows])
    kh = strength(list(hosts.values()), [mu] * len(hosts))
    post = {h: (sum(g) + kh * mu) / (len(g) + kh) for h, g in hosts.items()}
    kp = strength(list(paths.values()), [post[h] for h, _ in paths])
    logit = lambda x: np.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    got = {r["doc_id"]: r for r in quality.combine(df).collect()}
    for i, h, p, v in rows:
        host = (sum(hosts[h]) - v + kh * mu) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[(h, p)]) - v + kp * host) / (len(paths[(h, p)]) - 1 + kp)
        want = 1 / (1 + np.exp(-(logit(v) + logit(path) - logit(mu))))
        assert np.allclose([got[i]["host_post"], got[i]["path_post"], got[i]["quality"]], [host, path, want], atol=1e-9)
    assert 1 < kh < quality.MOST and 1 < kp < quality.MOST


def test_toxicity_trains_on_every_labelled_row(spark):
    """Toxic rows that come late by hashed doc_id have a word of their own: it is learned, whatever the number of rows."""
    ids = spark.range(6000).withColumnRenamed("id", "doc_id").withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    late = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"))) > 1500
    word = F.when(F.col("toxic") == 0, "fine").when(late, "omega").otherwise("alpha")
    rows = ids.withColumn("text", F.concat_ws(" ", F.lit("a"), word, F.lit("day"))).withColumn("lang", F.lit("en")).cache()
    model, cuts = toxicity.train(rows, rows.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, "a omega day"), (2, "a alpha day"), (3, "a fine day")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, probe, model, ["doc_id"]).collect()}
    assert got[1] > 0.9 and got[2] > 0.9 and got[3] < 0.1 and set(cuts) == {None, "en"}
    assert toxicity.training_rows(rows, rows.select("doc_id", "toxic")).count() == rows.filter(~toxicity.held_out()).count()


def test_toxicity_thresholds_equal_a_plain_search(spark):
    """The best F1 over every row of a language, tried cut by cut."""
    rng = np.random.default_rng(8)
    rows = []
    for lang, n in (("en", 3000), ("de", 400), (None, 60), ("fr", 12)):
        y = rng.random(n) < 0.3
        rows += [(lang, int(t), float(s)) for t, s in zip(y, np.clip(rng.normal(0.35 + 0.25 * y, 0.15), 0, 1).round(3) + 0.0004)]
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, toxic int, score double"))

    def f1(own, cut):
        tp = sum(t for t, s in own if s >= cut)
        return 2 * tp / (sum(s >= cut for _, s in own) + sum(t for t, _ in own))

    assert set(got) == {None, "en", "de", ""}
    for g, cut in got.items():
        own = [(t, s) for lang, t, s in rows if g is None or (lang or "") == g]
        assert toxicity.CUTS[0] < cut < toxicity.CUTS[1]
        assert abs(f1(own, cut) - max(f1(own, s) for s in {s for _, s in own})) < 1e-12
    assert toxicity.thresholds(spark.createDataFrame(rows[-3:], "lang string, toxic int, score double")) == {None: 0.5}
