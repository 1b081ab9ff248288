"""Periodic runs of words by maximal pairs of the LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_LENGTH, 2 * q)`` words that no neighbouring word extends.

A pair of equal stretches of l words at i < j is maximal if the words before
them differ and the words after them differ.  If j - i <= l, the words from i
to j + l have period j - i and no neighbour extends them, so a maximal pair of
bounded distance is a run without any extension step.  The pairs are read off
the tree of LCP intervals (suffixes of one document that share their first l
words), bottom-up: an interval's positions are the merged lists of its child
intervals, and two positions of different children share exactly l words.
Positions carry the class of their left word; a pair of one class is never
maximal.  For the smallest period no third position of the interval lies
between i and j (else a shorter period would hold), so only neighbours in the
merged list are compared, and the smaller list is merged into the larger one.

Runs have l >= q and l + q >= MIN_LENGTH, so l >= MIN_LENGTH / 2 =: m.  Only
subtrees of depth m are built, and none whose positions all have one left word.
Each task orders the suffixes of a chunk of whole documents by prefix doubling
in numpy, starting with m-word ranks; matches never cross documents.  Nothing
is shuffled.

Defined cases: null, empty and blank texts have no words; a null doc_id plants
nothing; very long texts are whole (a chunk of their own); repeated rows get
equal results; an empty table gives no rows; other columns are ignored or, in
``runs``, passed through.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from collections.abc import Callable, Iterator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .textops import column_bytes, row_chunks, small_batches, split_words, word_hashes

MIN_LENGTH = 12

# bytes of words are kept as they are; byte 0, a word character here, becomes 255, which UTF-8 never has
_WORD = np.arange(256, dtype=np.uint8)
_WORD[0] = 255
_WORD[[32, *range(9, 14)]] = 0


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of every key among the distinct ones."""
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def _windows(text: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """Ranks of the m-symbol windows of one row, in lexicographic order inside a row; rows share no rank."""
    def after(r, k):
        return np.concatenate([r[k:], np.zeros(min(k, len(r)), r.dtype)])

    rank, size = _dense(text), 1
    want = [row, None, None]
    while size * 2 < m:                              # ranks of 1, 2, 4, ... symbols
        bits = int(rank.max(initial=0)).bit_length()
        if bits * 3 <= 62 and size * 3 <= m:         # three at a time where they fit
            rank = _dense((rank << (2 * bits)) | (after(rank, size) << bits) | after(rank, 2 * size))
            size *= 3
        else:
            rank = _dense((rank << bits) | after(rank, size))
            size *= 2
    if size < m:
        bits = int(rank.max(initial=0)).bit_length()
        far = after(rank, m - size)
        if 2 * bits + int(want[0].max(initial=0)).bit_length() <= 62:
            return (row << (2 * bits)) | (rank << bits) | far
        rank = _dense((rank << bits) | far)
    return (row << int(rank.max(initial=0)).bit_length()) | rank


class Suffixes:
    """Suffix order of the rows of ``text`` (0 ends a row) as far as suffixes share m symbols with another of
    their row: ``sa`` (grouped by the first m symbols, ordered in each group), ``head`` (first of its group),
    ``lcp`` (with the suffix before it, inside a group)."""

    def __init__(self, text: np.ndarray, row: np.ndarray, m: int):
        n = len(text)
        key = _windows(text, row, m)
        o = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[o][1:] != key[o][:-1]
        rank = np.empty(n, np.int64)
        rank[o] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        sa = o
        self.head = new[place]
        levels = [(m, rank)]
        h = m
        todo = place
        while len(todo):
            pos = sa[todo]
            a, b = rank[pos], rank[np.minimum(pos + h, n - 1)]
            by = np.lexsort((b, a))
            pos, a, b = pos[by], a[by], b[by]
            sa[todo] = pos
            first = np.ones(len(todo), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            rank = rank.copy()
            rank[pos] = np.maximum.accumulate(np.where(first, todo, 0))
            same = ~first
            same[:-1] |= ~first[1:]
            todo = todo[same]
            h *= 2
            if len(todo):
                levels.append((h, rank))
        self.sa = sa[place]
        self.text, self.levels, self.m = text, levels, m

    def keep(self, groups: np.ndarray) -> None:
        """Drop the groups (by number) that are not marked."""
        mine = groups[np.cumsum(self.head) - 1]
        self.sa, self.head = self.sa[mine], self.head[mine]

    def lcp(self) -> np.ndarray:
        """Symbols shared with the suffix before, 0 at a group's head."""
        at = np.flatnonzero(~self.head)
        a, b = self.sa[at - 1], self.sa[at]
        n = np.zeros(len(at), np.int64)
        top = len(self.text) - 1
        for h, rank in reversed(self.levels):
            n += h * (rank[np.minimum(a + n, top)] == rank[np.minimum(b + n, top)])
        live = np.arange(len(at))
        for _ in range(self.m - 1):
            x = self.text[np.minimum(a[live] + n[live], top)]
            live = live[(x == self.text[np.minimum(b[live] + n[live], top)]) & (x != 0)]
            n[live] += 1
        out = np.zeros(len(self.sa), np.int64)
        out[at] = n
        return out


def _pairs(sa: list[int], lcp: list[int], left: dict[int, int], least: int, out: list) -> None:
    """Maximal pairs (i, j, l) with j - i <= l and j - i + l >= least of one group, by its LCP-interval tree."""
    def merged(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k, word = bisect_left(a, x), left[x]
            if k and x - a[k - 1] <= depth and left[a[k - 1]] != word:
                out.append((a[k - 1], x, depth))
            if k < len(a) and a[k] - x <= depth and left[a[k]] != word:
                out.append((x, a[k], depth))
        for x in b:
            insort(a, x)
        return a

    open_: list[tuple[int, list[int]]] = []            # intervals on the way to the root: depth, positions so far
    now = [sa[0]]
    for depth, x in zip(lcp, sa[1:]):
        while open_ and open_[-1][0] >= depth:
            d, have = open_.pop()
            now = merged(have, now, d)
            # an interval of this very depth stays open for more children
            if d == depth:
                break
        open_.append((depth, now))
        now = [x]
    while open_:
        d, have = open_.pop()
        now = merged(have, now, d)


def runs_of(words: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH):
    """(row, start, length, period) arrays of all runs, by row, start and period.

    ``words``: numbers (from 1) of the words of all rows, row r at ``first[r]:first[r + 1]``.
    """
    none = np.zeros(0, np.int64)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    n = len(words) + len(count)
    text = np.zeros(n, np.int64)
    at = np.arange(len(words)) + rows
    text[at] = words
    row = np.zeros(n, np.int64)
    row[at] = rows
    row[first[1:] + np.arange(len(count))] = np.arange(len(count))
    m = (least + 1) // 2
    if len(words) < 2 * m:
        return none, none, none, none
    s = Suffixes(text, row, m)
    if len(s.sa) == 0:
        return none, none, none, none
    before = text[s.sa - 1]
    before[s.sa == 0] = 0
    starts = np.flatnonzero(s.head)
    s.keep(np.minimum.reduceat(before, starts) != np.maximum.reduceat(before, starts))
    if len(s.sa) == 0:
        return none, none, none, none
    lcp = s.lcp()
    starts = np.append(np.flatnonzero(s.head), len(s.sa))
    left = dict(zip(s.sa.tolist(), np.where(s.sa > 0, text[s.sa - 1], 0).tolist()))
    sa, shared = s.sa.tolist(), lcp.tolist()
    found: list[tuple[int, int, int]] = []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
        _pairs(sa[a:z], shared[a + 1:z], left, least, found)
    found = [(i, j, k) for i, j, k in found if j - i + k >= least]
    if not found:
        return none, none, none, none
    i, j, k = (np.array(x, np.int64) for x in zip(*found))
    period, length = j - i, j - i + k
    o = np.lexsort((period, length, i))
    i, length, period = i[o], length[o], period[o]
    new = np.ones(len(i), bool)                      # multiples of a run's period give the same stretch
    new[1:] = (i[1:] != i[:-1]) | (length[1:] != length[:-1])
    i, length, period = i[new], length[new], period[new]
    r = row[i]
    start = i - (first[r] + r)
    o = np.lexsort((period, start, r))
    return r[o], start[o], length[o], period[o]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) of a document whose words from a on are replaced by a period of p words; else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Found:
    """Runs of a slice of whole texts, and what is left when every run keeps its first period only."""

    def __init__(self, col: pa.Array, plant: Callable[[int, int], tuple[int, int] | None], least: int = MIN_LENGTH):
        self.data, off = column_bytes(col)
        folded, self.s, self.e, self.first = split_words(self.data, off, _WORD)
        n = len(self.s)
        self.count = np.diff(self.first)
        self.source = np.arange(n)                   # the original word at every place
        self.changed = np.zeros(len(self.count), bool)
        for r in range(len(self.count)):
            how = plant(r, int(self.count[r]))
            if how:
                a, p = how
                lo = self.first[r] + a
                self.source[lo:self.first[r + 1]] = lo + np.arange(self.count[r] - a) % p
                self.changed[r] = True
        number = _dense(word_hashes(folded, self.s, self.e)) + 1 if n else np.zeros(0, np.int64)
        self.row, self.start, self.length, self.period = runs_of(number[self.source], self.first, least)
        edge = np.zeros(n + 1, np.int64)
        at = self.first[self.row] + self.start
        np.add.at(edge, at + self.period, 1)
        np.add.at(edge, at + self.length, -1)
        self.kept = np.cumsum(edge[:-1]) == 0
        self.bounds = np.searchsorted(self.row, np.arange(len(self.count) + 1))

    def collapsed(self) -> list[bytes]:
        """The kept words of every row, joined by one space."""
        data, kept = self.data, self.kept & ~np.repeat(self.changed, self.count)
        mark = np.zeros(len(data) + 1, np.int8)
        mark[self.s[kept]] += 1
        np.subtract.at(mark, self.e[kept], 1)
        take = np.cumsum(mark[:-1], dtype=np.int8) > 0
        at = np.flatnonzero(kept)
        row = np.repeat(np.arange(len(self.count)), self.count)[at]
        more = np.zeros(len(at), bool)
        more[:-1] = row[1:] == row[:-1]
        gap = self.e[at[more]]
        take[gap] = True
        spaced = data.copy()
        spaced[gap] = 32
        out = spaced[take].tobytes()
        size = np.bincount(row, self.e[at] - self.s[at] + more, len(self.count)).astype(np.int64)
        ends = np.cumsum(size)
        lists = [out[z - k:z] for z, k in zip(ends.tolist(), size.tolist())]
        raw = data.tobytes() if self.changed.any() else b""
        for r in np.flatnonzero(self.changed):
            w = self.source[self.first[r]:self.first[r + 1]][self.kept[self.first[r]:self.first[r + 1]]]
            lists[r] = b" ".join([raw[a:b] for a, b in zip(self.s[w].tolist(), self.e[w].tolist())])
        return lists


def _map(df: DataFrame, keep: list[str], fields: list[T.StructField], kernel) -> DataFrame:
    """``keep`` columns and ``fields``; ``kernel`` gets a slice's texts and doc_ids and returns a list of rows' values."""
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in keep] + fields)
    names, n = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, off = column_bytes(b.column(n))
            for lo, hi in row_chunks(off):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + kernel(part.column(n), part.column(n + 1).to_pylist()), names=names)

    cols = [df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)]
    return df.select(*cols, df["text"].alias("t"), df["doc_id"].cast("long").alias("d")).mapInArrow(run, schema)


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def runs(docs: DataFrame, keep: list[str] | None = None, least: int = MIN_LENGTH) -> DataFrame:
    """``keep`` columns (all) of every row, ``runs`` (start, length, period in words) and ``collapsed``, the text's
    words without the repeats."""
    def kernel(text: pa.Array, _: list) -> list[pa.Array]:
        f = Found(text, lambda r, n: None, least)
        each = list(zip(f.start.tolist(), f.length.tolist(), f.period.tolist()))
        return [pa.array([[{"start": a, "length": b, "period": c} for a, b, c in each[x:y]] for x, y in zip(f.bounds[:-1], f.bounds[1:])],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([c.decode() for c in f.collapsed()], pa.string())]

    return _map(docs, list(keep or docs.columns), [T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())], kernel)


DIGEST = ([T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
          + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")])


def digest(docs: DataFrame) -> DataFrame:
    """Contract digest of every row: runs after planting by doc_id."""
    def kernel(text: pa.Array, ids: list) -> list[pa.Array]:
        f = Found(text, lambda r, n: planted(ids[r], n))
        sums, best = [], []
        for a, z in zip(f.bounds[:-1].tolist(), f.bounds[1:].tolist()):
            each = list(zip(f.start[a:z].tolist(), f.length[a:z].tolist(), f.period[a:z].tolist()))
            sums.append(hashlib.sha256("".join(f"{x},{y},{q}\n" for x, y, q in each).encode()).hexdigest())
            best.append(min(each, key=lambda t: (-t[1], t[0], t[2]), default=None))
        one = [pa.array([b and b[k] for b in best], pa.int64()) for k in range(3)]
        return [pa.array(np.diff(f.bounds), pa.int64()), *one, pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                pa.array(sums, pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in f.collapsed()], pa.string())]

    return _map(docs, ["doc_id"], DIGEST, kernel)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest for every row of documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def crc32_sql(text: str) -> str:
    """DuckDB expression of the CRC-32 of a VARCHAR's UTF-8 bytes, where CRC_TABLE's ``crc`` is joined."""
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode({text}))), "
            f"lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)), "
            f"lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])))")


CRC_TABLE = ("crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], "
             "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)")

ORACLE = rf"""
WITH {CRC_TABLE},
w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents, crc),
w1 AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM w0),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n),
             lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS ws FROM w1),
six AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, n - 5)) AS i FROM d) x),
eq AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
isl AS (SELECT doc_id, p, min(i) AS start, count(*) + 5 + p AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM eq) x GROUP BY doc_id, p, g),
run AS (SELECT doc_id, start, length, min(p) AS period FROM isl WHERE length >= 2 * p AND length >= 12 GROUP BY doc_id, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
txt AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t
         FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(ws) AS w FROM d) w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(txt.n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       ((1000 * best.length) // best.period)::BIGINT AS exponent_milli, sha256(coalesce(txt.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN txt USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
