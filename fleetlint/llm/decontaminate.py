"""Benchmark decontamination with an FM-index per training shard.

Each task turns its rows into shards.  A shard is the word sequence of its
rows over the benchmark's own alphabet: a word outside it can be in no
occurrence, so only stretches of benchmark words as long as the shortest
window are indexed (exact, nothing is lost).  The index holds the
Burrows-Wheeler transform of the stretches as a wavelet matrix with ranks at
every level and suffix positions sampled every ``SAMPLE`` words and at every
stretch start.  All windows are searched backward together; occurrences are
located by walking to a sampled position, checked against the words' bytes,
and merged into removal spans.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is
``WINDOW`` consecutive words of an item; a shorter item, if not empty, is one
window.

Defined cases: null and empty texts have no words and stay as they are; null
or empty items have no windows; a null item_id takes part as the text
``null``; an item_id given twice counts once per document; an empty benchmark
hits nothing; repeated rows get equal results; very long texts are whole
(a row longer than a chunk is a shard of its own).  Columns other than the
text are passed through; an operator column replaces an equally named one.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import written
from .textops import ALNUM, column_bytes, fresh, map_text, split_words, word_hashes

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 2 << 20
#: words of benchmark text held by one phrase block; a larger benchmark takes one pass over the documents a block
BLOCK_WORDS = 1_000_000


@dataclass
class Phrases:
    """Distinct windows of a block of items, grouped by length, over a small alphabet."""

    vocab: np.ndarray                              # sorted word hashes; symbol = place + 1
    groups: list = field(default_factory=list)     # (length, symbols (n, length), owners: (window, item) pairs)
    words: list = field(default_factory=list)      # bytes of each symbol's word
    items: list = field(default_factory=list)      # item ids as text
    shortest: int = WINDOW


def phrases_of(rows: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """Phrase tables of (item id, text) rows."""
    col = pa.array([t or "" for _, t in rows], pa.large_string())
    data, off = column_bytes(col)
    folded, s, e, at = split_words(data, off, ALNUM)
    h = word_hashes(folded, s, e)
    vocab, first = np.unique(h, return_index=True)
    p = Phrases(vocab)
    p.words = [folded[s[i]:e[i]].tobytes() for i in first]
    names = sorted({i for i, _ in rows})
    number = {n: k for k, n in enumerate(names)}
    p.items = names
    sym = (np.searchsorted(vocab, h) + 1).astype(np.int32)
    by_len: dict[int, list] = {}
    for r, (item, _) in enumerate(rows):
        w = sym[at[r]:at[r + 1]]
        if len(w) == 0:
            continue
        k = min(window, len(w))
        v = np.lib.stride_tricks.sliding_window_view(w, k)
        by_len.setdefault(k, []).append((v, np.full(len(v), number[item])))
    for k, parts in sorted(by_len.items()):
        allw = np.concatenate([v for v, _ in parts])
        owner = np.concatenate([o for _, o in parts])
        uniq, back = np.unique(allw, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([back.reshape(-1), owner], 1), axis=0)
        p.groups.append((k, uniq, pairs))
    p.shortest = min(by_len, default=window)
    return p


class FMIndex:
    """FM-index of ``text`` (symbols 1..sigma; 0 ends each stretch, and the text)."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        stops = np.flatnonzero(text == 0)
        # suffix order by prefix doubling; every stop is its own rank, so order is settled within stretches
        rank = text.astype(np.int64) + len(stops)
        rank[stops] = np.arange(len(stops))
        sa = np.argsort(rank, kind="stable")
        rank = self._name(rank[sa], sa, n)
        h = 1
        while True:
            by = rank[sa]
            tied = np.zeros(n, bool)
            tied[1:] = by[1:] == by[:-1]
            tied[:-1] |= tied[1:]
            places = np.flatnonzero(tied)
            if len(places) == 0:
                break
            pos = sa[places]
            second = rank[np.minimum(pos + h, n - 1)]
            o = np.lexsort((second, by[places]))
            pos, a, b = pos[o], by[places][o], second[o]
            sa[places] = pos
            new = np.ones(len(places), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.maximum.accumulate(np.where(new, places, 0))
            rank = rank.copy()
            rank[pos] = head
            h *= 2
        self.n, self.sigma = n, sigma
        bwt = text[sa - 1]
        self.bwt = bwt
        count = np.bincount(text, minlength=sigma + 2)
        self.c = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[stops[:-1] + 1] = True
        sampled = starts | (np.arange(n) % SAMPLE == 0) | (text == 0)
        self.marked = sampled[sa]
        self.marks = np.cumsum(self.marked) - 1
        self.positions = sa[self.marked]
        self.bits, self.zeros = [], []
        level = bwt.astype(np.int32)
        for b in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            one = (level >> b) & 1
            self.bits.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(int(n - one.sum()))
            level = np.concatenate([level[one == 0], level[one == 1]])

    @staticmethod
    def _name(keys: np.ndarray, sa: np.ndarray, n: int) -> np.ndarray:
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return rank

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before place ``i`` of the transform."""
        start = np.zeros(len(i), np.int64)
        top = len(self.bits) - 1
        for k, (ones, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (sym >> (top - k)) & 1 == 1
            a, b = ones[start], ones[i]
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of every window, by backward search."""
        lo = np.zeros(len(windows), np.int64)
        hi = np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for j in range(windows.shape[1] - 1, -1, -1):
            s = windows[live, j]
            lo[live] = self.c[s] + self.rank(s, lo[live])
            hi[live] = self.c[s] + self.rank(s, hi[live])
            live = live[lo[live] < hi[live]]
            if len(live) == 0:
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled row, count the steps."""
        out = np.empty(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.positions[self.marks[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            s = self.bwt[at]
            at = self.c[s] + self.rank(s, at)
            steps += 1
        return out


def occurrences(p: Phrases, folded, s, e, rows):
    """(first word, length, group number, window number) of every occurrence in a shard, verified."""
    none = np.zeros(0, np.int64)
    if not p.groups or len(s) == 0:
        return none, none, none, none
    h = word_hashes(folded, s, e)
    place = np.searchsorted(p.vocab, h)
    place[place == len(p.vocab)] = 0
    known = p.vocab[place] == h
    sym = np.where(known, place + 1, 0)
    n = len(sym)
    edge = np.ones(n, bool)                      # a stretch begins: row start, or after an unknown word
    edge[1:] = ~known[:-1]
    edge[rows[:-1][rows[:-1] < n]] = True
    begin = np.flatnonzero(known & edge)
    over = np.ones(n, bool)
    over[:-1] = ~known[1:] | edge[1:]
    finish = np.flatnonzero(known & over) + 1
    size = finish - begin
    long = size >= p.shortest
    begin, size = begin[long], size[long]
    if len(begin) == 0:
        return none, none, none, none
    total = size + 1
    base = np.cumsum(total) - total
    text = np.zeros(int(total.sum()), np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(base, size) + inner] = sym[np.repeat(begin, size) + inner]
    index = FMIndex(text, len(p.vocab))
    firsts, lengths, groups, windows = [], [], [], []
    for g, (k, uniq, _) in enumerate(p.groups):
        lo, hi = index.search(uniq)
        found = np.flatnonzero(hi > lo)
        if len(found) == 0:
            continue
        reps = hi[found] - lo[found]
        row = np.repeat(lo[found] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        pos = index.locate(row)
        run = np.searchsorted(base, pos, side="right") - 1
        word = begin[run] + pos - base[run]
        win = np.repeat(found, reps)
        ok = _verified(p, uniq, win, word, folded, s, e)
        firsts.append(word[ok])
        windows.append(win[ok])
        lengths.append(np.full(int(ok.sum()), k))
        groups.append(np.full(int(ok.sum()), g))
    if not firsts:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in (firsts, lengths, groups, windows))


def _verified(p: Phrases, uniq, win, word, folded, s, e) -> np.ndarray:
    """Whether the words' bytes are those of the window (hashes of equal words are equal, not the reverse)."""
    k = uniq.shape[1]
    at = word[:, None] + np.arange(k)
    sym = uniq[win] - 1
    ok = np.ones(len(word), bool)
    flat_at, flat_sym = at.reshape(-1), sym.reshape(-1)
    uniq_at, first = np.unique(flat_at, return_index=True)   # a word position has one symbol
    good = np.fromiter((folded[s[a]:e[a]].tobytes() == p.words[flat_sym[i]] for a, i in zip(uniq_at, first)), bool, len(uniq_at))
    if not good.all():
        bad = set(uniq_at[~good].tolist())
        ok = ~np.isin(at, list(bad)).any(axis=1)
    return ok


def scan(col: pa.Array, p: Phrases):
    """Per row: words, hit words, item numbers, and (row, byte start, byte end) spans of a column slice."""
    data, off = column_bytes(col)
    folded, s, e, rows = split_words(data, off, ALNUM)
    n_rows = len(rows) - 1
    word, length, group, win = occurrences(p, folded, s, e, rows)
    mark = np.zeros(len(s) + 1, np.int64)
    np.add.at(mark, word, 1)
    np.add.at(mark, word + length, -1)
    hit = np.cumsum(mark[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[rows[1:]] - total[rows[:-1]]
    row = np.searchsorted(rows, word, side="right") - 1
    items: list[list[int]] = [[] for _ in range(n_rows)]
    for g, (_, _, owners) in enumerate(p.groups):
        mine = group == g
        if mine.any():
            pair = np.unique(np.stack([row[mine], win[mine]], 1), axis=0)
            lo = np.searchsorted(owners[:, 0], pair[:, 1], side="left")
            hi = np.searchsorted(owners[:, 0], pair[:, 1], side="right")
            for r, a, b in zip(pair[:, 0], lo, hi):
                items[r].extend(owners[a:b, 1].tolist())
    # spans: runs of hit words, never across rows
    flag = hit.copy()
    new = flag.copy()
    new[1:] &= ~flag[:-1]
    first_words = rows[:-1][rows[:-1] < len(s)]
    new[first_words] |= flag[first_words]
    a = np.flatnonzero(new)
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | new[1:]
    b = np.flatnonzero(stop)
    r = np.searchsorted(rows, a, side="right") - 1
    return np.diff(rows), n_hit, [sorted(set(x)) for x in items], (r, s[a] - off[r], e[b] - off[r])


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Phrase tables of the whole benchmark, block by block; each block is bounded by ``block_words``
    (an item of more words is a block of its own)."""
    src = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                           F.coalesce("text", F.lit("")).alias("text")).orderBy("item", "text")
    rows, words = [], 0
    for r in src.toLocalIterator():
        n = len(r["text"]) // 2 + 1                 # no text has more words
        if rows and words + n > block_words:
            yield phrases_of(rows, window)
            rows, words = [], 0
        rows.append((r["item"], r["text"]))
        words += n
    if rows:
        yield phrases_of(rows, window)


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]


def shared_blocks(spark: SparkSession, blocks: list[Phrases]) -> list:
    """Broadcasts of blocks; plain values, so that any worker can read them."""
    return [spark.sparkContext.broadcast(vars(b)) for b in blocks]


def find(spark: SparkSession, docs: DataFrame, blocks: list[Phrases], keep: list[str], text: str = "text", shared: list | None = None) -> DataFrame:
    """``keep`` columns plus n_words, n_hit, items (sorted) and spans (byte start and end of each
    run of hit words).  The given blocks are searched within the task, so no join is needed; hits of the blocks are merged
    per row.  ``shared``: broadcasts of the blocks that the caller frees."""
    shared = shared_blocks(spark, blocks) if shared is None else shared

    def kernel(col: pa.Array) -> list[pa.Array]:
        n = len(col)
        ps = [Phrases(**b.value) for b in shared]
        found = [scan(col, p) for p in ps]
        items = [[] for _ in range(n)]
        spans: list[list] = [[] for _ in range(n)]
        if not found:
            data, off = column_bytes(col)
            rows = split_words(data, off, ALNUM)[3]
            words, hits = np.diff(rows), np.zeros(n, np.int64)
        else:
            words, hits = found[0][0], found[0][1]
        for p, (_, _, own, (r, a, z)) in zip(ps, found):
            for i, x in enumerate(own):
                if x:
                    items[i] += [p.items[k] for k in x]
            for i, x, y in zip(r.tolist(), a.tolist(), z.tolist()):
                spans[i].append([x, y])
        if len(found) > 1:
            spans = [_merged(x) for x in spans]
            hits = np.array([_hit_words(col[i].as_py() or "", x) for i, x in enumerate(spans)], np.int64)
        items = [sorted(set(x)) for x in items]
        return [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.list_(pa.int64())))]

    return map_text(docs, text, keep, FIELDS, kernel, SHARD_BYTES)


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _hit_words(text: str, spans: list) -> int:
    if not spans:
        return 0
    data, off = column_bytes(pa.array([text], pa.large_string()))
    _, s, _, _ = split_words(data, off, ALNUM)
    return int(sum(np.searchsorted(s, b) - np.searchsorted(s, a) for a, b in spans))


def _without(text: str, spans: list) -> str:
    """The text without the byte spans, each replaced by a line feed."""
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"\n".join(out).decode()


def cut(text: str, p: Phrases | list[Phrases]) -> str:
    """The text without its hit spans, each replaced by a line feed, repeated until nothing is hit."""
    ps = p if isinstance(p, list) else [p]
    while True:
        spans = _merged([[a, b] for q in ps for a, b in zip(*[x.tolist() for x in scan(pa.array([text], pa.large_string()), q)[3][1:]])])
        if not spans:
            return text
        text = _without(text, spans)


def remove(spark: SparkSession, docs: DataFrame, blocks: list[Phrases], text: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut from the text; n_chars, if there, follows the new text."""
    shared = [spark.sparkContext.broadcast(vars(b)) for b in blocks]     # plain values: any worker can read them

    def kernel(col: pa.Array) -> list[pa.Array]:
        hit = np.zeros(len(col), bool)
        ps = [Phrases(**b.value) for b in shared]
        for p in ps:
            hit |= scan(col, p)[1] > 0
        if not hit.any():
            return [col.cast(pa.string())]
        new = [cut(v.as_py(), ps) if h else v.as_py() for v, h in zip(col, hit)]
        return [pa.array(new, pa.string())]

    cols = docs.columns
    out = map_text(docs, text, [c for c in cols if c != text], [T.StructField(text, T.StringType())], kernel, SHARD_BYTES)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def block_hits(spark: SparkSession, docs: DataFrame, key: str, blocks) -> DataFrame:
    """(key, items, spans) of the rows that any block hits, one pass a block.

    The driver holds one block; it is broadcast, searched, and freed before the next.  ``docs``: key and text;
    rows of equal key have equal texts.  Hits are written a block at a time and merged by a grouped aggregate, one short
    list a block and row."""
    found = None
    for block in blocks:
        shared = shared_blocks(spark, [block])
        hits = find(spark, docs.select(key, "text"), [block], [key], shared=shared).filter("n_hit > 0").select(key, "items", "spans")
        hits = written(hits.dropDuplicates([key]), "passages")
        shared[0].destroy()
        found = hits if found is None else found.unionByName(hits)
    return written(found.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                          F.flatten(F.collect_list("spans")).alias("spans")), "passages")


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As ``find``, for a benchmark of any size: more than one block takes one pass each."""
    blocks = phrase_blocks(benchmark, window, block_words)
    few = list(itertools.islice(blocks, 2))
    if len(few) < 2:
        return find(spark, docs, few, keep)
    key, taken = fresh("key", docs.columns), [c for c in keep if c not in {f.name for f in FIELDS}]
    src = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    hits = block_hits(spark, src, key, itertools.chain(few, blocks))
    plain = src.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(taken)], "text", key)
    both = plain.join(hits.withColumnRenamed("items", "_items").withColumnRenamed("spans", "_spans"), key, "left")
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in taken] + FIELDS)

    def merge(batches):
        n = len(taken)
        for b in batches:
            words, hit, items, spans = [], [], [], []
            for text, own, at in zip(b.column(n), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                text = text.as_py() or ""
                data, off = column_bytes(pa.array([text], pa.large_string()))
                merged = _merged(at or [])
                words.append(int(split_words(data, off, ALNUM)[3][-1]))
                hit.append(_hit_words(text, merged))
                items.append(own or [])
                spans.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                                             pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[f.name for f in schema.fields])

    return both.select(*[f"k{i}" for i in range(len(taken))], "text", "_items", "_spans").mapInArrow(merge, schema)


def remove_all(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As ``remove``, for a benchmark of any size: more than one block takes passes over the hit rows until nothing is hit."""
    blocks = list(itertools.islice(phrase_blocks(benchmark, window, block_words), 2))
    if len(blocks) < 2:
        return remove(spark, docs, blocks)
    cols = docs.columns
    key = fresh("key", cols)
    live = written(docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), "decontaminated")
    while True:
        hits = block_hits(spark, live, key, phrase_blocks(benchmark, window, block_words))
        if hits.isEmpty():
            break
        spans = hits.select(key, F.col("spans").alias("_spans"))
        schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_new", T.StringType())])

        def cut_rows(batches):
            for b in batches:
                new = [_without(t, _merged(at)) for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=[key, "_new"])

        made = written(live.select(key, "text").join(spans, key).dropDuplicates([key]).mapInArrow(cut_rows, schema), "cut")
        joined = live.join(made, key, "left").withColumn("text", F.coalesce("_new", "text"))
        live = written(joined.withColumn(key, F.when(F.col("_new").isNotNull(), F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.col(key))).drop("_new"), "decontaminated")
    out = live
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest per document, plus the merged byte spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = search(spark, docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut from their texts; documents that were nothing else go."""
    was = fresh("was", docs.columns)
    out = remove_all(spark, docs.withColumn(was, F.coalesce(F.length("text"), F.lit(0))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    emptied = (F.col(was) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"), F.lit(False)) & (F.length("text") < F.col(was))
    return out.filter(~emptied).select(*docs.columns)


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) the plain way; for tests on small inputs."""
    import re
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    doc = words(text)
    hit, got = set(), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j:j + k] == w[i:i + k]:
                    got.add(item)
                    hit.update(range(j, j + k))
    return len(doc), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
