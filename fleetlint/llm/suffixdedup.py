"""Removal of long repeated byte strings by distributed prefix doubling on sampled suffixes.

A byte goes if a ``LENGTH``-byte string covering it also starts in a document
with a smaller doc_id (judged on the input; matches never cross documents).

Ranking every suffix of the corpus would shuffle many times the input, so the
doubling runs on a sample of suffixes that loses nothing: each window of LENGTH
bytes names the suffix at the smallest of its ``PIECE``-byte hashes (leftmost if
tied).  Equal windows name the same place in themselves, so windows can only be
equal if the suffixes they name agree in their first PIECE bytes.

1. Equal texts are one text, owned by the smallest doc_id; other owners of a
   text of LENGTH or more bytes lose all of it.
2. Round one ranks the sampled suffixes by their first PIECE bytes over the
   whole corpus; ranks of a single document drop out (combined per task
   before the shuffle).
3. Spark sorts the remaining (rank, position) rows, each with the bytes of the
   windows that name it.  In every sorted run rank pairs at offset 16 give
   ranks of 32 bytes, unique ones drop out, and pairs at offset 18 give ranks
   of 50 bytes: past the threshold.  The smallest document of each rank decides.
4. Ranks with very many rows (``hot_limit``: a share of all rows, at most a
   million) are not sorted into one run: their windows are reduced to the
   smallest and largest document, first in each task, then by a grouped
   aggregate, and looked up again.
5. Window ranges are gathered per document and cut from the text.

Names of pieces and windows are 64-bit hashes of the bytes.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; a
null doc_id loses nothing and takes nothing; rows that share a doc_id do not
take from each other; repeated rows get equal results; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import in_filter, membership
from .spans import written
from .textops import _BASE, _CODES, column_bytes, map_text, mix64, row_chunks, small_batches

LENGTH = 50
PIECE = 16
BLOCK = 1 << 16                 # bytes named at a time: the arrays stay in the processor's cache
TEXT_BYTES = 1 << 19            # whole rows handled at a time
HOT_SHARE, HOT_ROWS = 5000, (500, 1_000_000)
BROADCAST_IDS = 1_000_000
RUN_ROWS = 4_000                # rows of whole runs ranked together
FLUSH_ROWS = 500_000            # names held by a task before it sends them on


def names(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit names of all k-byte strings of ``data``, built by doubling."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    part, size = _CODES[data], 1
    out, have = None, 0
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                m = len(data) - have - size + 1
                out = out[:m] * power(size) + part[have:have + m]
                have += size
        if have == k:
            return mix64(out)
        m = len(part) - size
        part = part[:m] * power(size) + part[size:size + m]
        size *= 2


def sampled(data: np.ndarray, off: np.ndarray):
    """(row, suffix start, first window, last window, name of the suffix's first PIECE bytes) of every
    sampled suffix; positions are within ``data``."""
    rows, places, lows, highs, ranks = [], [], [], [], []
    span = LENGTH - PIECE + 1
    for s in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        piece = data[s:s + BLOCK + LENGTH - 1]
        g = names(piece, PIECE)
        key = (g & ~np.uint64((1 << 21) - 1)) | np.arange(len(g), dtype=np.uint64)   # order by name, then place
        low, size = key, 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n = len(g) - span + 1
        low = np.minimum(low[:n], low[span - size:span - size + n])
        at = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.arange(s, s + n)
        row = np.searchsorted(off, start, side="right") - 1
        inside = start + LENGTH <= off[row + 1]
        start, row, at = start[inside], row[inside], at[inside]
        if len(start) == 0:
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        rows.append(row[first])
        places.append(at[first] + s)
        lows.append(start[first])
        highs.append(start[last])
        ranks.append(g[at[first]])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (rows, places, lows, highs, ranks))


def _chunks(batches, text: int):
    for b in batches:
        _, off = column_bytes(b.column(text))
        for lo, hi in row_chunks(off, TEXT_BYTES):
            yield b, lo, hi, *column_bytes(b.column(text).slice(lo, hi - lo))


def first_ranks(texts: DataFrame) -> DataFrame:
    """(h, docs, places): sampled ranks with the number of texts and of suffixes that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush():
            h, back, c = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True, return_counts=True)
            n = np.bincount(back.reshape(-1), np.concatenate([y for _, y in held])).astype(np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "c", "n"])

        for _, _, _, data, off in _chunks(batches, 0):
            row, _, _, _, h = sampled(data, off)
            o = np.lexsort((h, row))
            h, row = h[o], row[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            held.append((h[first], np.diff(np.append(first, len(h)))))
            size += int(new.sum())
            if size > FLUSH_ROWS:
                yield flush()
                size = 0
        if held:
            yield flush()

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "h long, c int, n int").groupBy("h").agg(F.sum("c").alias("docs"), F.sum("n").alias("places"))


def hot_limit(places: int) -> int:
    """Rows above which a rank is hot: the same share of the corpus at every size, within HOT_ROWS."""
    return min(HOT_ROWS[1], max(HOT_ROWS[0], places // HOT_SHARE))


def doubled(ctx: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each window of the rows' bytes also starts in a smaller document among these rows.

    Row i holds ``off[i+1] - off[i] - LENGTH + 1`` windows.  Ranks of 16 bytes
    are paired at offset 16, sorted and reranked; windows left alone drop out;
    ranks of 32 bytes are paired at offset 18.
    """
    count = np.diff(off) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    at = off[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(row), bool)
    if len(row) == 0:
        return out
    r16 = names(ctx, PIECE)
    r32 = r16[:-PIECE] * np.uint64(0x9E3779B97F4A7C15) + mix64(r16[PIECE:])      # name of the rank pair at offset 16
    left = np.arange(len(row))
    for key in (r32[at], mix64(r32[at]) + r32[at + LENGTH - 2 * PIECE]):
        key = key[left]
        o = np.argsort(key)
        k = key[o]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        last_key, left = k[same], left[o[same]]
        if len(left) == 0:
            return out
    new = np.ones(len(left), bool)
    new[1:] = last_key[1:] != last_key[:-1]
    first = np.flatnonzero(new)
    d = doc[row[left]]
    low = np.minimum.reduceat(d, first)[np.cumsum(new) - 1]
    out[left] = low < d
    return out


def _ranges(flag: np.ndarray, count: np.ndarray, low: np.ndarray):
    """(row, first window, last window) of every run of flagged windows inside a row."""
    row = np.repeat(np.arange(len(count)), count)
    place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    f = np.flatnonzero(flag)
    if len(f) == 0:
        return f, f, f
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1] + 1) | (row[f[1:]] != row[f[:-1]])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(f)) - 1
    return row[f[a]], place[f[a]], place[f[b]]


RANGE = "doc long, tag int, lo int, hi int"


def _range_batch(doc, tag, lo, hi):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                      names=["doc", "tag", "lo", "hi"])


def window_ranges(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """RANGE rows: windows [lo, hi] of a text that also start in a smaller document.

    ``texts``: doc, tag, text; one row per distinct text.
    """
    ranks = written(first_ranks(texts).filter("docs > 1"), "ranks")
    total, n = ranks.agg(F.sum("places"), F.count("*")).first()
    few = ranks.filter(F.col("places") > hot_limit(total or 0)).select("h").collect()      # by the limit a tiny part of the ranks
    hot = np.sort(np.array([r["h"] for r in few], np.int64).view(np.uint64))
    bits, size = membership(ranks, n)
    shared = spark.sparkContext.broadcast((bits, size, hot))

    def split(h):
        f, b, hot_names = shared.value
        keep = in_filter(f, b, h)
        place = np.minimum(np.searchsorted(hot_names, h), max(0, len(hot_names) - 1))
        is_hot = (hot_names[place] == h) if len(hot_names) else np.zeros(len(h), bool)
        return keep & ~is_hot, is_hot

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, r0, _, data, off in _chunks(batches, 2):
            row, _, low, high, h = sampled(data, off)
            keep = split(h)[0]
            row, low, high, h = row[keep], low[keep], high[keep], h[keep]
            size_ = high + LENGTH - low
            ends = np.cumsum(size_)
            take = np.repeat(low - (ends - size_), size_) + np.arange(int(size_.sum()))
            ctx = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(row + r0)), b.column(1).take(pa.array(row + r0)),
                                              pa.array((low - off[row]).astype(np.int32)), ctx], names=["h", "doc", "tag", "lo", "ctx"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            ctx, off = column_bytes(t.column("ctx"))
            doc, lo = t.column("doc").to_numpy(), t.column("lo").to_numpy()
            tag = t.column("tag").to_numpy()
            flag = doubled(ctx, off, doc)
            r, a, z = _ranges(flag, np.diff(off) - LENGTH + 1, lo)
            return _range_batch(doc[r], tag[r], a, z)

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < RUN_ROWS:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1], side="left"))      # the last run may go on
            if whole:
                yield work(t.slice(0, whole))
            held, rows = t.slice(whole).combine_chunks().to_batches(), t.num_rows - whole
        if held and rows:
            yield work(pa.Table.from_batches(held))

    src = texts.select("doc", "tag", "text")
    runs = src.mapInArrow(named, "h long, doc long, tag int, lo int, ctx binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = runs.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(rank, RANGE)
    if len(hot) == 0:
        return out

    def hot_windows(batches):
        """(batch, row offset, row, place, window name) of the windows of hot ranks, chunk by chunk."""
        for b, r0, _, data, off in _chunks(batches, 2):
            row, _, low, high, h = sampled(data, off)
            is_hot = split(h)[1]
            row, low, high = row[is_hot], low[is_hot], high[is_hot]
            if len(row) == 0:
                continue
            count = high - low + 1
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            r = np.repeat(row, count)
            yield b, r0, r, at - off[r], names(data, LENGTH)[at]

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            w, d = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o = np.lexsort((d, w))
            w, d = w[o], d[o]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            last = np.append(first[1:], len(w)) - 1
            return pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(d[first]), pa.array(d[last])], names=["w", "low", "high"])

        for b, r0, r, _, w in hot_windows(batches):
            held.append((w, b.column(0).to_numpy()[r + r0]))
            size += len(w)
            if size > FLUSH_ROWS:
                yield flush()
                size = 0
        if held:
            yield flush()

    low = written(src.mapInArrow(extremes, "w long, low long, high long").groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                  .filter("low < high").select("w", "low"), "windows")
    if low.count() > BROADCAST_IDS:
        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, r0, r, at, w in hot_windows(batches):
                i = pa.array(r + r0)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), b.column(0).take(i), b.column(1).take(i), pa.array(at.astype(np.int32))], names=["w", "doc", "tag", "lo"])

        more = src.mapInArrow(every, "w long, doc long, tag int, lo int").join(low, "w").filter("low < doc").select("doc", "tag", "lo", F.col("lo").alias("hi"))
        return out.unionByName(more)
    table = low.toArrow()                                   # at most BROADCAST_IDS windows
    w = table.column("w").to_numpy().view(np.uint64)
    o = np.argsort(w)
    known = spark.sparkContext.broadcast((w[o], table.column("low").to_numpy()[o]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, smallest = known.value
        for b, r0, r, at, w in hot_windows(batches):
            if len(names_) == 0:
                return
            place = np.minimum(np.searchsorted(names_, w), len(names_) - 1)
            doc = b.column(0).to_numpy()[r + r0]
            gone = (names_[place] == w) & (smallest[place] < doc)
            r, at, doc = r[gone], at[gone], doc[gone]
            if len(r):
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(r)) - 1
                yield _range_batch(doc[first], b.column(1).to_numpy()[r[first] + r0], at[first], at[last])

    return out.unionByName(src.mapInArrow(mark, RANGE))


def cut_text(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, kept bytes) for window ranges [lo, hi]."""
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi + LENGTH, -1)
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row."""
    tag = F.hash(F.coalesce("text", F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), tag.alias("tag"))
    sums = base.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select(
        "doc_id", "tag", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("b"), "text").alias("t2"))
    owner = sums.groupBy("t1", "t2", "tag").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("top")).filter("own < top")
    copies = written(sums.join(owner, ["t1", "t2", "tag"]).filter("doc_id > own").select("doc_id", "tag").distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    rest = base.join(copies, ["doc_id", "tag"], "left_anti")
    texts = rest.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select(F.col("doc_id").alias("doc"), "tag", "text")
    ranges = written(window_ranges(spark, texts).groupBy(F.col("doc").alias("doc_id"), "tag")
                     .agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("doc_id", "tag", "r.lo", "r.hi"), "ranges")
    # lists are no longer than their document
    touched = ranges.select("doc_id", "tag")
    touched = F.broadcast(touched) if ranges.count() <= BROADCAST_IDS else touched
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                made = [cut_text(t.encode(), np.array(lo, np.int64), np.array(hi, np.int64)) for t, lo, hi in
                        zip(s.column(1).to_pylist(), s.column(2).to_pylist(), s.column(3).to_pylist())]
                kept = [m[2] if with_text else b"" for m in made]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([len(t.as_py().encode()) for t in s.column(1)], pa.int64()), pa.array([m[0] for m in made], pa.int64()),
                     pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), *fields[:2], T.StructField("kept_sha256", T.StringType()), fields[2]])
    some = (rest.join(touched, ["doc_id", "tag"], "left_semi").join(ranges, ["doc_id", "tag"])
                .select("doc_id", "text", "lo", "hi").mapInArrow(cut, schema))
    size = F.octet_length("text").cast("long")
    none = rest.join(touched, ["doc_id", "tag"], "left_anti").select(
        "doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), (F.col("text").cast("binary") if with_text else F.lit(b"")).alias("kept"))
    whole = base.join(copies, ["doc_id", "tag"], "left_semi").select(
        "doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
    out = some.unionByName(none).unionByName(whole)
    return out if with_text else out.drop("kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest for every row of documents."""
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
