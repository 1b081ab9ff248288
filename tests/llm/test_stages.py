"""Stages and pass-through operators: odd inputs, clashing columns, empty tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlint.llm import decontaminate, mixing, secrets, setjoin, toxicity


def as_text(df):
    return sorted(map(str, df.collect()))


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "source_mixing"]


@pytest.mark.parametrize("stage", [toxicity.stage, decontaminate.stage, secrets.stage])
def test_clean_rows_pass_unchanged(spark, odd_docs, small, stage):
    out = stage(spark, odd_docs, small)
    assert out.columns == odd_docs.columns
    assert as_text(out) == as_text(odd_docs)


def test_join_stage_keeps_distinct_rows(spark, odd_docs, small):
    out = setjoin.stage(spark, odd_docs, small)
    assert out.columns == odd_docs.columns
    assert as_text(out) == as_text(odd_docs)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_input(spark, no_docs, small, stage):
    assert stage(spark, no_docs, small).count() == 0


def test_mixing_keeps_columns(odd_docs):
    out = mixing.deal(odd_docs)
    made = {"epoch", "block", "block_key", "doc_key", "weight"}
    assert set(out.columns) == set(odd_docs.columns) | made
    assert out.filter("key <> 'x' or _t <> 'x'").count() == 0


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{base}/{name}")
        out[name] = (docs, spark.read.parquet(f"{base}/{name}"))
        docs = out[name][1]
    return out


def test_toxic_documents_go(spark, small, staged):
    docs, kept = staged["toxicity"]
    toxic = spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1")
    assert kept.join(toxic, "doc_id").count() <= 0.1 * docs.join(toxic, "doc_id").count()
    clean = spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 0")
    assert kept.join(clean, "doc_id").count() >= 0.95 * docs.join(clean, "doc_id").count()


def test_scores_spread_on_few_labels(spark, small):
    r = toxicity.op7(spark, small).join(spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    low, high = (r.filter(F.col("toxic") == t).agg(F.avg("score")).first()[0] for t in (0, 1))
    assert high - low > 0.5


def test_one_document_of_a_class_stays(spark, staged):
    """Against a plain five-word join over all pairs."""
    docs, kept = staged["ngram_jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(5, len(w))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
    up = {d: d for d in sets}

    def top(d):
        return d if up[d] == d else top(up[d])

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d in sets if up[d] == d)
    assert kept.count() < docs.count()


def test_benchmark_passages_are_cut(spark, small, staged):
    one, cut = staged["benchmark_decontamination"]
    blocks = list(decontaminate.phrase_blocks(spark.read.parquet(f"{small}/benchmark.parquet")))
    assert decontaminate.find(spark, one, blocks, ["doc_id"]).filter("n_hit > 0").count() > 0
    assert decontaminate.find(spark, cut, blocks, ["doc_id"]).filter("n_hit > 0").count() == 0
    clean = decontaminate.find(spark, one, blocks, ["doc_id"]).filter("n_hit = 0").select("doc_id")
    same = one.join(clean, "doc_id").select("doc_id", "text")
    assert same.join(cut.select("doc_id", F.col("text").alias("t2")), "doc_id").filter("text = t2").count() == same.count()


def test_secrets_are_cut(spark, staged):
    cut, safe = staged["secret_scans"]
    assert safe.count() == cut.count() and secrets.scan(safe).filter(F.size("base") > 0).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert secrets.scan(docs).filter(F.size("base") > 0).count() > 0
    assert secrets.scan(secrets.stage(spark, docs, None)).filter(F.size("base") > 0).count() == 0


def test_mixing_deals_every_source(staged):
    safe, mixed = staged["source_mixing"]
    assert set(safe.columns) < set(mixed.columns)
    assert mixed.select("source").distinct().count() == safe.select("source").distinct().count()


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, small, tmp_path):
    """All stages in a row on nulls, empty and long texts, repeats and clashing columns, and on no rows."""
    for what, docs in (("odd", odd_docs), ("none", no_docs)):
        before, cols = docs.count(), docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{what}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{what}-{name}")
            if k < 4:
                assert docs.columns == cols and docs.count() == before
        assert (docs.count() > 0) == (before > 0)


def test_pipeline_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and {"doc_id", "text", "epoch", "block_key", "doc_key"} <= set(out.columns)
