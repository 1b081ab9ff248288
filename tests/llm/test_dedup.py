"""N-gram Jaccard join, repeated byte strings and decontamination against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlint.llm import decontaminate, graph, setjoin, suffixdedup

fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    k = min(4, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    par = {d: d for d, _ in rows if d is not None}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if rows[i][0] is None or rows[j][0] is None or not a or not b:
            continue
        x = len(a & b)
        if 100 * x >= 85 * (len(a) + len(b) - x):
            p, q = sorted((find(rows[i][0]), find(rows[j][0])))
            par[q] = p
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comp = {r["doc_id"]: r["component_id"] for r in setjoin.classes(spark, docs).collect()}
    sizes = np.diff(setjoin.shingles(*_bytes([t for _, t in rows]))[1]).tolist()
    return [(d, n, comp.get(d)) for (d, _), n in zip(rows, sizes)]


def _bytes(texts):
    from fleetlint.llm.textops import column_bytes
    return column_bytes(pa.array(texts, pa.string()))


def edited(rng, words, rate):
    return [rng.choice("abcdefghij") + w if rng.random() < rate else w for w in words]


def test_join_random_families(spark):
    """Families of near copies around the threshold, with common passages, chains and case changes."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    common = " ".join(rng.choice(vocab) for _ in range(12))
    rows = []
    for f in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 20, 60, 200]))]
        for c in range(rng.choice([1, 3, 8])):
            base = edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04]))
            rows.append((rng.randrange(10**6), " ".join(base).upper() if c == 2 else " ".join(base) + ("\n" + common if f % 3 == 0 else "")))
    assert joined(spark, rows) == brute_classes(rows)


def test_join_probes_families_not_their_rows(spark, monkeypatch):
    """Rows just below the threshold from a large family meet it once a shared shingle, not once a shingle and member."""
    rng = random.Random(8)
    base, tail = [f"v{i}" for i in range(150)], [f"t{i}" for i in range(11)]      # the tail is frequent, so what all rows of the family share comes first
    rows = [(9000 + i, " ".join([*base[:138], *tail, f"x{i}"])) for i in range(8)]
    rows += [(i, " ".join(edited(rng, base, 0.004))) for i in range(80)]
    rows += [(20000 + i, " ".join([f"z{i}y{j}" for j in range(30)] + tail)) for i in range(200)]
    made = []
    hits = setjoin.family_hits

    def counted(index, percent):
        made.append(hits(index, percent).count())
        return hits(index, percent)

    monkeypatch.setattr(setjoin, "family_hits", counted)
    assert joined(spark, rows) == brute_classes(rows)
    assert 0 < made[0] < 8 * 80                 # not even one for each pair of rows


def test_join_of_rows_that_share_a_doc_id(spark):
    """A doc_id with a text near its family's root and another far from it: the far one's links count."""
    rng = random.Random(9)
    one, two = [f"v{i}" for i in range(120)], [f"u{i}" for i in range(120)]
    rows = [(1, " ".join(one)), (5, " ".join(edited(rng, one, 0.01))), (5, " ".join(two)), (3, " ".join(two[:118])), (8, " ".join(two[2:]))]
    assert joined(spark, rows) == brute_classes(rows)


def test_join_hot_family_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(edited(rng, base, 0.012))) for i in range(120)]
    rows += [(i, " ".join(base)) for i in range(500, 540)]                       # equal texts
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "x"), (7, "y"), (8, "y"),
             (9, "é ü ñ 漢"), (10, "É ü ñ 漢"), (11, "word " * 30000), (12, "word " * 4), (4, "one two")]
    assert joined(spark, rows) == brute_classes(rows)


def test_join_is_independent_of_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in setjoin.classes(spark, docs.repartition(1)).collect()}
    assert a == {tuple(r) for r in setjoin.classes(spark, docs.repartition(9)).collect()}


def test_join_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.op4(spark, small).collect())
    assert got == sorted(brute_classes(rows))


def five_word_jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set())
    return len(sets[0] & sets[1]), len(sets[0] | sets[1])


def test_join_stage_takes_five_words_and_four_fifths(spark):
    """The stage against brute force, with scattered and contiguous edits on both sides of 0.80."""
    rng = random.Random(11)
    rows = []
    for f in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([7, 60, 120, 200]))]
        rows.append((10 * f, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            if (f + c) % 2:
                cut = round(len(copy) * rng.uniform(0.02, 0.14))
                at = rng.randrange(len(copy) - cut)
                copy[at:at + cut] = [f"x{f}.{c}.{i}" for i in range(cut)]
            else:
                copy = edited(rng, copy, rng.uniform(0.01, 0.03))
            rows.append((10 * f + c, " ".join(copy)))
    par, between = {d: d for d, _ in rows}, 0

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        inter, union = five_word_jaccard(a, b)
        if 100 * inter >= 80 * union:
            between += 100 * inter < 85 * union
            p, q = sorted((find(i), find(j)))
            par[q] = p
    assert between >= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in setjoin.stage(spark, docs, "").collect()) == sorted(d for d in par if find(d) == d)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 70), (200, 199), (100, 50)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 70: 50, 200: 199, 199: 199}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows):
    first = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - 49):
                s = b[i:i + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, ids", [(500, 10**6), (2, 10**6), (2, 0)])
def test_repeats(spark, monkeypatch, hot, ids):
    """Random, periodic, copied and overlapping texts; with ranks taking the paths of hot ranks, too."""
    monkeypatch.setattr(suffixdedup, "HOT_ROWS", (hot, hot))
    monkeypatch.setattr(suffixdedup, "BROADCAST_IDS", ids)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    p = [word(40), word(55), word(120), word(400)]
    rows = []
    for i in range(60):
        parts = [rng.choice(p) if rng.random() < 0.6 else word(rng.randrange(5, 90)) for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(10**4), "".join(parts)))
    rows += [(20000, "x" * 300), (20001, "x" * 49), (20002, "x" * 50), (20003, "x" * 51 + "y"), (3, "ab" * 200), (20004, "ba" * 100), (20005, None), (20006, ""),
             (None, "x" * 300), (20007, rows[0][1]), (20008, rows[0][1]), (20008, rows[0][1]), (20009, rows[1][1] + "!"), (20009, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in suffixdedup.dedup(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute_removed(rows)


def test_repeats_across_blocks(spark, monkeypatch):
    """Texts longer than a block of the sampler give the same suffixes."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, 1200, 1200, 5000])
    whole = suffixdedup.sampled(data, off)
    monkeypatch.setattr(suffixdedup, "BLOCK", 700)
    cut = suffixdedup.sampled(data, off)
    windows = lambda s: {(int(p), int(a)) for _, a, lo, hi, _ in zip(*s) for p in range(lo, hi + 1)}
    assert windows(whole) == windows(cut) and len(windows(whole)) == (1200 - 49) + (3800 - 49)


def test_repeats_query_and_empty(spark, small, no_docs, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in suffixdedup.op8(spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute_removed(rows)
    assert suffixdedup.dedup(spark, no_docs).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in suffixdedup.dedup(spark, odd_docs, with_text=True).collect() if r["doc_id"] in (1, 2, 6)}
    assert kept == {1: b"", 2: b"", 6: "é ü 漢字 ñ 42".encode()}


BENCH = [(1, "The quick brown fox jumps over the lazy dog and runs away from here"), (2, "short item"), (3, ""), (4, None), (5, "a a a a a a a a a a a a"),
         (None, "null id item is here"), (2, "short item"), (7, "SHORT item!")]
DOCS = [(1, "x the QUICK brown fox, jumps over the lazy dog and runs away from here y"), (2, "short-item short item short"), (3, "a " * 30), (4, None), (5, ""),
        (6, "the quick brown fox jumps over the lazy cat and runs away from here"), (None, "null id item is here"), (1, "a " * 11), (8, "z " * 20000 + "short item")]


def bench_items():
    return [("null" if i is None else str(i), t) for i, t in BENCH]


@pytest.mark.parametrize("words", [decontaminate.BLOCK_WORDS, 5])
def test_passages(spark, words):
    blocks = list(decontaminate.phrase_blocks(spark.createDataFrame(BENCH, "item_id long, text string"), block_words=words))
    assert (len(blocks) > 1) == (words == 5)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
           for r in decontaminate.find(spark, docs, blocks, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(d, *decontaminate.brute_force(t, bench_items())) for d, t in DOCS], key=str)


def test_passages_random(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abc")
    items = [(str(i), " ".join(word() for _ in range(rng.randrange(0, 16)))) for i in range(12)]
    p = decontaminate.phrases_of(items)
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) + rng.choice(["", " zz ", "."]) for _ in range(60)]
    words, hits, own, _ = decontaminate.scan(pa.array(texts), p)
    got = [(int(w), int(h), len(o), hashlib.sha256(",".join(sorted(p.items[k] for k in o)).encode()).hexdigest()) for w, h, o in zip(words, hits, own)]
    assert got == [decontaminate.brute_force(t, items) for t in texts]


def test_fm_index():
    rng = np.random.default_rng(9)
    text = rng.integers(0, 4, 600)
    text[-1] = 0
    fm = decontaminate.FMIndex(text, 3)
    for k in (1, 2, 5):
        w = np.array(list(itertools.product([1, 2, 3], repeat=k)))[:200]
        lo, hi = fm.search(w)
        for x, a, b in zip(w, lo, hi):
            want = [i for i in range(600 - k + 1) if (text[i:i + k] == x).all()]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_cut_leaves_no_passage():
    p = decontaminate.phrases_of([("1", "a b c d e f g h i j")])
    # cutting the middle would bring the halves together
    text = "a b c d e [a b c d e f g h i j] f g h i j end"
    out = decontaminate.cut(text, p)
    assert decontaminate.scan(pa.array([out]), p)[1][0] == 0 and out.endswith("end")


def test_passage_query_and_empty(spark, small, no_docs, odd_docs):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.op6(spark, small).collect()}
    assert {d: got[d] for d in rows} == {d: decontaminate.brute_force(t, items) for d, t in rows.items()}
    assert decontaminate.find(spark, no_docs, [], ["doc_id"]).count() == 0
    none = decontaminate.find(spark, odd_docs, [], ["doc_id", "n_words"]).collect()
    assert sum(r["n_words"] for r in none) == 32000 + 3 + 3 + 5 + 5 and all(r["n_hit"] == 0 for r in none)


def test_decontamination_block_by_block(spark):
    """A benchmark of many blocks: one pass a block, merged hits and cuts as with one block."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    items = [(f"b{i}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 12, 25])))) for i in range(12)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(4)]
        parts.insert(2, rng.choice(items)[1])
        texts.append(" é ".join(parts))
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    cols = ["doc_id", "n_words", "n_hit", "items", "spans", "key"]
    one = sorted(map(str, decontaminate.search(spark, docs, bench, ["doc_id", "key"]).select(*cols).collect()))
    many = sorted(map(str, decontaminate.search(spark, docs, bench, ["doc_id", "key"], block_words=20).select(*cols).collect()))
    assert one == many and len(list(decontaminate.phrase_blocks(bench, block_words=20))) > 5
    for r in decontaminate.search(spark, docs, bench, ["doc_id"], block_words=20).collect():
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert (r["n_words"], r["n_hit"], len(r["items"])) == decontaminate.brute_force(texts[r["doc_id"]], items)[:3]
    a, b = (decontaminate.remove_all(spark, docs, bench, block_words=n) for n in (10**6, 20))
    assert a.columns == b.columns == docs.columns
    left = lambda df: {r["doc_id"]: decontaminate.brute_force(r["text"], items)[1] for r in df.collect()}
    assert set(left(b).values()) == {0} and left(a) == left(b)
    same = {r["doc_id"]: r["text"] for r in docs.collect() if decontaminate.brute_force(r["text"], items)[1] == 0}
    assert all(r["text"] == same[r["doc_id"]] for r in b.collect() if r["doc_id"] in same) and b.count() == len(rows)


def test_stars_name_their_edges_twice(spark):
    """A round's plan holds what its edges are made from no more often; the components are those of plain merging."""
    edges = [(9, 4), (4, 2), (7, 9), (20, 21), (21, 22), (5, 5), (9, 4)]
    e = spark.createDataFrame(edges, "a long, b long")
    for larger in (True, False):
        assert graph._star(e, larger)._jdf.queryExecution().analyzed().collectLeaves().size() == 2
    got = {r["id"]: r["root"] for r in graph.components(e).collect()}
    assert got == {2: 2, 4: 2, 7: 2, 9: 2, 20: 20, 21: 20, 22: 20}
