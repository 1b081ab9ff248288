"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z lower-cased (some lose a
code point by a rule on their document), of at least ``MIN_POINTS`` code points
and ``MIN_COUNT`` occurrences.  Two words are near if one inserted, deleted or
replaced code point makes them equal.  A word's form is its near word of largest
count, if that is at least twice the word's; its root is the end of the chain.

1. Counts are added up in every task and summed by Spark.
2. One error leaves one half of a word intact, so a near word begins with the
   word's first half or ends with its second half.  Every word goes to the
   buckets of its own two halves as a query, and to those of the (four) halves
   that words of its length and one more or less may ask for as an entry.  A
   bucket of more than ``HOT`` entries is dealt over several salts and its queries
   to each of them, so no task meets an unbounded bucket.
3. A task indexes the entries of complete buckets, about ``RUN_WORDS`` at a time: the
   delimited vocabulary ``#w1#w2#...#`` in an FM-index, and the reversed words in a
   second one.  A match is a pair of suffix-rank intervals of one size; a step to
   the left works in the first transform and shifts the interval in the second,
   a step to the right the other way round.
   Scheme one matches the first half to the left up to its delimiter, then
   turns and extends across the second half with one error; scheme two mirrors
   it.  The rank of ``#word#`` among the suffixes of the delimiter names the word.
4. Pairs found by both schemes count once; Spark picks the forms and follows them
   to the roots by pointer jumping, the distance doubling every round.

Defined cases: null and empty texts have no words; a null doc_id changes no word;
rows that share a doc_id, or are repeated, count each; very long runs of letters
are words like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .periodic import CRC_TABLE, crc32_sql
from .spans import written
from .textops import column_bytes, row_chunks, small_batches, split_words, word_hashes

MIN_POINTS, MIN_COUNT = 5, 3
PLANT = 97
HELD_WORDS = 300_000
RUN_WORDS = 40_000
HOT = 20_000
LEAD = 0xC3                     # first byte of U+00C0 to U+00FF in UTF-8; the second is any continuation byte

_SAME = np.arange(256, dtype=np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[LEAD] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- words and counts -------------------------------------------------------------------------

_SHIFT: dict[int, np.ndarray] = {}


def shifted(crc: np.ndarray, n: int) -> np.ndarray:
    """CRC-32s after n more zero bytes, without their effect on an empty start: the CRC is linear, so
    crc(A + B) = shifted(crc(A), len(B)) xor crc(B)."""
    if n not in _SHIFT:
        zero = bytes(n)
        base = zlib.crc32(zero)
        table = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for bit in range(8):
                table[k, 1 << bit:2 << bit] = table[k, :1 << bit] ^ np.uint32(zlib.crc32(zero, 1 << (8 * k + bit)) ^ base)
        _SHIFT[n] = table
    t = _SHIFT[n]
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def count_words(col: pa.Array, ids: list[int | None], plant: int = PLANT, least: int = MIN_POINTS) -> Counter:
    """UTF-8 word -> occurrences in a slice of whole texts."""
    data, off = column_bytes(col)
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == LEAD
    folded, s, e, first = split_words(np.where(inside, _LOWER[data], 0).astype(np.uint8), off, _SAME)
    if len(s) == 0:
        return Counter()
    _, at, number = np.unique(word_hashes(folded, s, e), return_index=True, return_inverse=True)
    number = number.reshape(-1)
    raw = folded.tobytes()
    words = [raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())]
    size = e - s
    own = np.array([zlib.crc32(w) for w in words], np.uint32)[number]
    row = np.repeat(np.arange(len(ids)), np.diff(first))
    start = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], np.uint32)[row]
    named = np.array([d is not None for d in ids], bool)[row]
    crc = np.zeros(len(s), np.uint32)
    for n in np.unique(size).tolist():
        i = np.flatnonzero(size == n)
        crc[i] = shifted(start[i], n) ^ own[i] if n <= 64 else [zlib.crc32(words[k], int(c)) for k, c in zip(number[i], start[i])]
    hit = named & (crc % plant == 0)
    leads = np.concatenate([[0], np.cumsum(folded == LEAD)])
    points = (size - (leads[e] - leads[s]))
    total = np.bincount(number[~hit], minlength=len(words))
    long = (points[at] >= least) & (total > 0)
    out = Counter({words[i]: int(total[i]) for i in np.flatnonzero(long)})
    for k, h in zip(number[hit].tolist(), crc[hit].tolist()):
        w = words[k].decode()
        if len(w) > least:
            p = h % len(w)
            out[(w[:p] + w[p + 1:]).encode()] += 1
    return out


def vocabulary(docs: DataFrame, plant: int = PLANT, least: int = MIN_POINTS, count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of every word of ``docs`` (doc_id, text) with at least ``least`` code points and ``count`` occurrences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            _, off = column_bytes(b.column(1))
            for lo, hi in row_chunks(off):
                held.update(count_words(b.column(1).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo).to_pylist(), plant, least))
                if len(held) > HELD_WORDS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


# ---- bidirectional index ----------------------------------------------------------------------

PACK, BITS = 8, 7               # symbols of a first sort key; 90 letters and the delimiter fit 7 bits


class Side:
    """FM-index of delimited words (symbols from 1; 0 is the delimiter), given in their sorted order."""

    def __init__(self, words: list[np.ndarray], sigma: int):
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum()) + len(words) + 1
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[np.concatenate([[0], np.cumsum(size + 1)])] = False
        text[inner] = np.concatenate(words)
        stops = np.flatnonzero(~inner)
        ahead = np.append(stops, n)[np.searchsorted(stops, np.arange(n), side="right")] - np.arange(n)   # to the next delimiter
        key = np.zeros(n, np.int64)
        for k in range(PACK):
            x = np.zeros(n, np.int64)
            x[:n - k] = text[k:]
            key = (key << BITS) | np.where(ahead >= k, x, 0)
        sa = np.argsort(key, kind="stable")              # suffixes equal up to a delimiter keep their places' order
        rank, h = self._heads(key[sa], sa), PACK
        todo = self._tied(rank[sa], ahead[sa] >= h)
        while len(todo):
            pos = sa[todo]
            a, b = rank[pos], rank[np.minimum(pos + h, n - 1)]
            o = np.lexsort((pos, b, a))
            pos, a, b = pos[o], a[o], b[o]
            sa[todo] = pos
            new = np.ones(len(pos), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            rank = rank.copy()
            rank[pos] = np.maximum.accumulate(np.where(new, todo, 0))
            h *= 2
            todo = self._tied(rank[sa], ahead[sa] >= h)
        bwt = text[sa - 1]
        self.n = n
        self.c = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        self.levels = []                                 # wavelet matrix: ones before each place, and the zeros' count
        origin = np.zeros(sigma + 1, np.int64)           # where each symbol begins on the last level
        top = max(1, int(sigma).bit_length())
        symbols = np.arange(sigma + 1)
        for b in range(top - 1, -1, -1):
            one = (bwt >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one)])
            zeros = int(n - ones[-1])
            self.levels.append((ones, zeros))
            up = (symbols >> b) & 1 == 1
            origin = np.where(up, zeros + ones[origin], origin - ones[origin])
            bwt = np.concatenate([bwt[one == 0], bwt[one == 1]])
        self.origin = origin

    @staticmethod
    def _heads(by: np.ndarray, sa: np.ndarray) -> np.ndarray:
        new = np.ones(len(by), bool)
        new[1:] = by[1:] != by[:-1]
        rank = np.empty(len(by), np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        return rank

    @staticmethod
    def _tied(by: np.ndarray, unended: np.ndarray) -> np.ndarray:
        same = np.zeros(len(by), bool)
        same[1:] = by[1:] == by[:-1]
        same[:-1] |= same[1:]
        return np.flatnonzero(same & unended)

    def step(self, lo: np.ndarray, size: np.ndarray, sym: np.ndarray):
        """(new lo, new size, smaller symbols in the range) of the intervals extended by one symbol each."""
        a, z, less = lo, lo + size, np.zeros(len(lo), np.int64)
        top = len(self.levels) - 1
        for k, (ones, zeros) in enumerate(self.levels):
            up = (sym >> (top - k)) & 1 == 1
            i, j = ones[a], ones[z]
            less += np.where(up, (z - j) - (a - i), 0)
            a, z = np.where(up, zeros + i, a - i), np.where(up, zeros + j, z - j)
        return self.c[sym] + a - self.origin[sym], z - a, less

    def branch(self, lo: np.ndarray, size: np.ndarray):
        """(interval, symbol, new lo, new size, smaller) of every symbol that extends an interval."""
        at, sym = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        a, z, less = lo, lo + size, np.zeros(len(lo), np.int64)
        for ones, zeros in self.levels:
            i, j = ones[a], ones[z]
            low_a, low_z, up_a, up_z = a - i, z - j, zeros + i, zeros + j
            low, up = low_z > low_a, up_z > up_a
            at, sym = np.concatenate([at[low], at[up]]), np.concatenate([sym[low] * 2, sym[up] * 2 + 1])
            less = np.concatenate([less[low], (less + low_z - low_a)[up]])
            a, z = np.concatenate([low_a[low], up_a[up]]), np.concatenate([low_z[low], up_z[up]])
        return at, sym, self.c[sym] + a - self.origin[sym], z - a, less


class TwoWay:
    """The delimited vocabulary indexed in both directions."""

    def __init__(self, words: list[str]):
        """``words``: distinct and sorted."""
        self.words = words
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(flat)
        sym = np.searchsorted(self.alphabet, flat).astype(np.int64) + 1
        cut = np.cumsum([len(w) for w in words])[:-1]
        self.left = Side(np.split(sym, cut), len(self.alphabet))          # its steps go to the left
        back = sorted(range(len(words)), key=lambda i: words[i][::-1])
        parts = np.split(sym, cut)
        self.right = Side([parts[i][::-1] for i in back], len(self.alphabet))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text; letters that no word has get a number past the alphabet."""
        x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        i = np.minimum(np.searchsorted(self.alphabet, x), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == x, i + 1, len(self.alphabet) + 1).astype(np.int64)

    def near(self, queries: list[str], second_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of words that one error in the second (or else the first) half makes of the query."""
        halves = [(w[:len(w) // 2], w[len(w) // 2:]) for w in queries]
        if second_half:
            q, _, rank = self._scheme(self.left, self.right, [a[::-1] for a, _ in halves], [b for _, b in halves])
        else:
            q, rank, _ = self._scheme(self.right, self.left, [b for _, b in halves], [a[::-1] for a, _ in halves])
        real = rank > 0                                                   # rank 0 is the last delimiter, which begins no word
        pair = np.unique(np.stack([q[real], rank[real] - 1], 1), axis=0)
        return pair[:, 0], pair[:, 1]

    def _scheme(self, one: Side, two: Side, exact: list[str], loose: list[str]):
        """Match ``exact`` in side one up to a delimiter, then ``loose`` with one error in side two up to a delimiter.

        Returns (query, rank in side two, rank in side one).  Both parts are in the order of reading.
        """
        known = len(self.alphabet)

        def flat(parts):
            size = np.array([len(p) for p in parts], np.int64)
            return self.symbols("".join(parts)), np.cumsum(size) - size, size

        sym, base, size = flat(exact)
        q = np.arange(len(exact))
        x = np.zeros(len(q), np.int64)                                    # interval starts in side one and side two
        y = x.copy()
        n = np.full(len(q), one.n, np.int64)
        i = 0
        while True:
            ended = size[q] < i
            live = ~ended
            if not live.any():
                break
            s = np.zeros(len(q), np.int64)
            inner = size[q] > i
            s[inner] = sym[base[q[inner]] + i]                            # else the delimiter
            go = np.flatnonzero(live & (s <= known))
            a, m, less = one.step(x[go], n[go], s[go])
            ok = m > 0
            stay = np.flatnonzero(ended)
            q, x, y, n = (np.concatenate([u, v]) for u, v in zip((q[stay], x[stay], y[stay], n[stay]), (q[go][ok], a[ok], (y[go] + less)[ok], m[ok])))
            i += 1
        sym, base, size = flat(loose)
        at = np.zeros(len(q), np.int64)
        err = np.zeros(len(q), bool)
        out = []
        while len(q):
            pat = np.zeros(len(q), np.int64)
            inner = at < size[q]
            pat[inner] = sym[base[q[inner]] + at[inner]]
            # after the error: exact steps, the delimiter last
            e = np.flatnonzero(err & (pat <= known))
            b, m, less = two.step(y[e], n[e], pat[e])
            ok = m > 0
            e, b, m, a = e[ok], b[ok], m[ok], (x[e] + less)[ok]
            over = ~inner[e]
            out.append((q[e[over]], b[over], a[over]))
            e, a, b, m = e[~over], a[~over], b[~over], m[~over]
            nxt = [(q[e], a, b, m, at[e] + 1, np.ones(len(e), bool))]
            # before it: every letter that goes on; equal to the pattern, in its place, or put in before it
            z = np.flatnonzero(~err)
            p, c, b, m, less = two.branch(y[z], n[z])
            p, c, b, m, a = (v[c > 0] for v in (z[p], c, b, m, x[z[p]] + less))
            same = c == pat[p]
            nxt.append((q[p[same]], a[same], b[same], m[same], at[p[same]] + 1, np.zeros(int(same.sum()), bool)))
            other = ~same
            sub = other & inner[p]
            nxt.append((q[p[sub]], a[sub], b[sub], m[sub], at[p[sub]] + 1, np.ones(int(sub.sum()), bool)))
            nxt.append((q[p[other]], a[other], b[other], m[other], at[p[other]], np.ones(int(other.sum()), bool)))
            d = z[inner[z]]                                               # a letter of the pattern left out
            nxt.append((q[d], x[d], y[d], n[d], at[d] + 1, np.ones(len(d), bool)))
            q, x, y, n, at, err = (np.concatenate(v) for v in zip(*nxt))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (none, none, none)


# ---- Spark ------------------------------------------------------------------------------------

def near_pairs(spark: SparkSession, vocab: DataFrame, hot: int = HOT, run_words: int = RUN_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``vocab`` (word, n) that are one edit apart, once."""
    size = F.length("word")

    def half(n):
        return F.floor(n / 2).cast("int")

    tails = F.array_distinct(F.array(*[half(size + k) for k in (0, 1, 2)]))         # second halves of words one shorter, equal, one longer
    heads = F.array_distinct(F.array(*[half(size + k) for k in (-1, 0, 1)]))
    entries = vocab.select("word", "n", F.explode(F.concat(
        F.transform(heads, lambda k: F.concat(F.lit("<"), F.substring("word", F.lit(1), k))),
        F.transform(tails, lambda k: F.concat(F.lit(">"), F.substring("word", size - k + 1, k))))).alias("key"))
    queries = vocab.select("word", F.explode(F.array(
        F.concat(F.lit("<"), F.substring("word", F.lit(1), half(size))),
        F.concat(F.lit(">"), F.substring("word", half(size) + 1, size)))).alias("key"))
    big = written(entries.groupBy("key").count().filter(F.col("count") > hot)
                  .select("key", F.ceil(F.col("count") / hot).cast("int").alias("salts")), "hot")
    total = vocab.count()
    if not big.isEmpty():                                # at most 4 / hot of the words are hot keys
        entries, queries = (d.join(big, "key", "left") for d in (entries, queries))
    else:
        entries, queries = (d.withColumn("salts", F.lit(None).cast("int")) for d in (entries, queries))
    salts = F.coalesce("salts", F.lit(1))
    rows = (entries.select("key", F.pmod(F.xxhash64("word"), salts).cast("int").alias("salt"), F.lit(0).alias("kind"), "word", "n")
            .unionByName(queries.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(1).alias("kind"), "word", F.lit(0).cast("long").alias("n"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * total // 500_000)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def work(t: pa.Table):
            kind = t.column("kind").to_numpy()
            word = t.column("word")
            entry = t.filter(pa.array(kind == 0))
            counts = dict(zip(entry.column("word").to_pylist(), entry.column("n").to_pylist()))
            if not counts:
                return
            index = TwoWay(sorted(counts))
            first = np.array([k[0] == "<" for k in t.column("key").to_pylist()], bool)
            for second_half in (True, False):
                asked = word.filter(pa.array((kind == 1) & (first == second_half))).to_pylist()
                for lo in range(0, len(asked), 10_000):
                    block = asked[lo:lo + 10_000]
                    q, w = index.near(block, second_half)
                    near = [index.words[i] for i in w]
                    yield pa.RecordBatch.from_arrays([pa.array([block[i] for i in q], pa.string()), pa.array(near, pa.string()), pa.array([counts[x] for x in near], pa.int64())],
                                                     names=["word", "near", "near_n"])

        def cut(t: pa.Table) -> int:
            """First row of the last bucket, which may go on."""
            key, salt = t.column("key").to_pylist(), t.column("salt").to_pylist()
            i = len(key) - 1
            while i and (key[i - 1], salt[i - 1]) == (key[-1], salt[-1]):
                i -= 1
            return i

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n >= 2 * run_words:
                t = pa.concat_tables(held).combine_chunks()
                k = cut(t)
                if k:
                    yield from work(t.slice(0, k))
                held, n = [t.slice(k)], t.num_rows - k
        if n:
            yield from work(pa.concat_tables(held).combine_chunks())

    found = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(search, "word string, near string, near_n long")
    return found.repartition(parts, "word").dropDuplicates(["word", "near"])


def forms(spark: SparkSession, vocab: DataFrame, **limits) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of ``vocab`` (word, n)."""
    best = (near_pairs(spark, vocab, **limits).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")))
    good = -F.col("b.m") >= 2 * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n"))


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain of forms.

    Counts at least double along a chain, so it has no cycle and its length is at most the logarithm of the
    largest count; every round doubles the distance.
    """
    live = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = written(live.join(live.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
                      .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        live = nxt.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, plant: int = PLANT, least: int = MIN_POINTS, count: int = MIN_COUNT, **limits) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    vocab = written(vocabulary(docs, plant, least, count), "vocabulary")
    rows = written(forms(spark, vocab, **limits), "words")
    return rows.join(roots(rows), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: every word of documents."""
    return variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) x GROUP BY doc_id, w),
hashed AS (SELECT w, n, {crc32_sql("doc_id || ':' || w")} AS h FROM run, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) x),
near AS (SELECT a.word, b.word AS near, b.n FROM del a JOIN del b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON b.word = a.s
         UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON b.word = a.s),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 2 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * v.n THEN -b[1] END::BIGINT AS form_n
      FROM v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS at, form AS up FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.up)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.up IS NULL"""
