"""Line dedup, periodic runs and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fleetlint.llm import linededup, periodic, variants

SPACE = " \t\n\x0b\x0c\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def by_doc(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- lines ----

def plain_lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = fold(line).strip(SPACE)
            if d is not None and len(k) >= min_chars:
                holders[k].add(d)
    bad = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or bad.get(fold(x).strip(SPACE), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_rows(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "Béta", "漢字", "x\x00y", "delta"]) for _ in range(rng.choice([3, 7, 8, 9, 14]))) for _ in range(40)]
    rows = []
    for i in range(160):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + ["the one hot line that a third of all documents hold, in any case"] * (i % 3 == 0)
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", " ", "\r"]) for x in lines]
        rows.append((rng.choice([i, i, rng.randrange(20)]), "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(None, "\n".join(pool)), (None, None), (500, None), (501, ""), (502, "\n"), (503, pool[4] * 4000), (504, "\n".join(pool * 300)), rows[0], rows[0], (-7, rows[3][1])]
    return rows


@pytest.mark.parametrize("keys", [linededup.BROADCAST_KEYS, 0])
def test_lines_equal_plain_version(spark, keys):
    rows = line_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert by_doc(linededup.digest(spark, docs, broadcast_keys=keys)) == plain_lines(rows)


def test_lines_other_limits_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FLUSH", 10)
    rows = line_rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_doc(linededup.digest(spark, docs, min_chars=20, min_docs=2)) == plain_lines(rows, 20, 2)


def test_two_filters_miss_no_repeat():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    f, out = linededup.TwoFilters(10), set()              # far too small: more suspects, none missing
    for part in (h[:2000], h[1000:3000], h[2500:]):
        out |= set(f.add(np.unique(part), False).tolist())
    out |= set(f.add(h[:5], True).tolist())
    twice = set(h[1000:2000].tolist()) | set(h[2500:3000].tolist()) | set(h[:5].tolist())
    assert not [x for x in twice - out if not (f.twice[x & int(f.mask)])]
    big, seen = linededup.TwoFilters(4000), set()
    for part in (h[:2000], h[1000:3000], h[2500:]):
        seen |= set(big.add(np.unique(part), False).tolist())
    want = set(h[1000:2000].tolist()) | set(h[2500:3000].tolist())
    assert want <= seen and len(seen - want) < 400


def test_lines_odd_and_empty(spark, odd_docs, no_docs):
    out = linededup.clean(spark, odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert linededup.clean(spark, no_docs).count() == 0 and linededup.digest(spark, no_docs).count() == 0
    same = spark.createDataFrame([(i, "a line of words that is long enough to be repeated here\nown %d" % i, 9) for i in range(6)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.clean(spark, same).collect()}
    assert got[0] == ("own 0", 5) and got[5][0].startswith("a line") and got[5][1] == 9


# ---- periodic runs ----

def plain_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((i, n, p) for (i, n), p in out.items())


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_words(rng, k):
    unit = [rng.randint(1, k) for _ in range(rng.randint(1, 9))]
    w = [rng.randint(1, k) for _ in range(rng.choice([0, 3, 11, 12, 30]))] + unit * rng.randint(2, 7) + unit[:rng.randint(0, len(unit))] + [rng.randint(1, k) for _ in range(5)]
    return w * rng.choice([1, 1, 2])


@pytest.mark.parametrize("least", [12, 11, 4, 30])
def test_runs_equal_plain_version(least):
    rng = random.Random(least)
    docs = [periodic_words(rng, rng.choice([1, 2, 3, 8])) for _ in range(400)] + [[], [1], [1] * 5000, [1, 2] * 40]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = defaultdict(list)
    for r, s, n, p in zip(*(x.tolist() for x in periodic.runs_of(np.array(sum(docs, []), np.int64), first, least))):
        got[r].append((s, n, p))
    for i, d in enumerate(docs):
        if len(d) < 1000:
            assert got[i] == plain_runs(d, least), d
    assert got[402] == [(0, 5000, 1)]


def test_runs_digest_equals_plain_version(spark):
    rng = random.Random(9)
    names = ["a", "A", "é", "x\x00", "漢字", "z9", "long-word", "q"]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\n", "\x0b "]).join(names[x - 1] for x in periodic_words(rng, rng.choice([1, 3, 8])))) for i in range(300)]
    rows += [(None, "a b " * 20), (None, None), (10**12, ""), (-5, " \n"), (7, "w " * 3000), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((plain_digest(*r) for r in rows), key=repr)
    assert by_doc(periodic.digest(docs)) == want
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10


def test_runs_odd_and_empty(spark, odd_docs, no_docs):
    out = periodic.runs(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) | {"runs", "collapsed"} and out.count() == odd_docs.count()
    long = out.filter("doc_id = 3").first()
    assert [tuple(r) for r in long["runs"]] == [(0, 32000, 4)] and long["collapsed"] == "alpha beta gamma delta"
    assert periodic.runs(no_docs).count() == 0 and periodic.digest(no_docs).count() == 0


# ---- spelling variants ----

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, plant=97, least=5, count=3):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = fold(w)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % plant == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n), key=repr)


def typos(rng, w):
    p = rng.randrange(len(w))
    return rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("aeçÿ") + w[p:], w[:p] + rng.choice("aeçÿ") + w[p + 1:]])


def word_rows(seed, docs=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéç") for _ in range(rng.choice([5, 6, 7, 9, 18, 40]))) for _ in range(30)]
    base += [typos(rng, w) for w in base] + [typos(rng, typos(rng, w)) for w in base]
    rows = [(i, rng.choice(" -1_\n").join(rng.choice([w, w.upper()]) if w.isascii() else w for w in rng.choices(base, [1 + (k % 30) ** 2 // 9 for k in range(len(base))], k=40)))
            for i in range(docs)]
    return rows + [(None, "abcde abcde abcde"), (None, None), (7, ""), (8, "漢字 ×÷×÷× Àbcdé" * 3), (9, "ab" * 5000 + " " + "ab" * 5000 + " " + "ab" * 5000), rows[0], rows[0]]


def test_index_equals_all_pairs():
    for seed, letters in enumerate(["ab", "abcé", "xyzabcdefgh"]):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 9, 17, 18]))) for _ in range(250)} | {("ab" * 40)[:k] for k in (77, 78, 79)})
        index = variants.TwoWay(words)
        asked = words + ["zzzzz", "ab", "añb"]
        got = {(asked[q], words[w]) for half in (True, False) for q, w in zip(*index.near(asked, half))}
        assert got == {(a, b) for a in asked for b in words if a != b and one_edit(a, b)}


def test_intervals_of_both_sides_agree():
    """A step to either side gives both intervals of the extended match."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    index = variants.TwoWay(words)
    one, a, m, _ = index.left.branch(np.zeros(1, np.int64), np.array([index.left.n]))[1:]
    text = "#" + "#".join(words) + "#"
    for s, n in zip(one.tolist(), m.tolist()):
        c = "#" if s == 0 else chr(index.alphabet[s - 1])
        assert n == text.count(c)
    lo, n, less = index.left.step(a, m, np.full(len(a), 1))
    for s, k in zip(one.tolist(), n.tolist()):
        if s:
            pair = "a" + chr(index.alphabet[s - 1])
            assert k == sum(text.startswith(pair, i) for i in range(len(text)))


@pytest.mark.parametrize("limits", [{}, {"hot": 20, "run_words": 15}])
def test_variants_equal_plain_version(spark, limits, monkeypatch):
    rows = word_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_doc(variants.variants(spark, docs, **limits).select("word", "form", "root", "n", "n_near", "form_n")) == plain_variants(rows)


def test_planted_words(spark):
    rows = word_rows(4, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in variants.vocabulary(docs, plant=3, least=1, count=1).collect()}
    want = {w: n for w, _, _, n, _, _ in plain_variants(rows, 3, 1, 1)}
    assert got == want


def test_crc_of_joined_texts():
    for a, b in [("12:", "word"), ("", "x"), ("7:", "é" * 30)]:
        x = np.array([zlib.crc32(a.encode())], np.uint32)
        n = len(b.encode())
        assert int(variants.shifted(x, n)[0]) ^ zlib.crc32(b.encode()) == zlib.crc32((a + b).encode())


def test_variants_odd_and_empty(spark, odd_docs, no_docs):
    out = {r["word"]: r["n"] for r in variants.variants(spark, odd_docs).collect()}
    assert out == {"alpha": 8000, "gamma": 8000, "delta": 8000, "three": 3}
    assert variants.variants(spark, no_docs).count() == 0
    assert variants.count_words(pa.array([], pa.string()), []) == Counter()
