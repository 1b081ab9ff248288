"""Removal of lines that repeat across documents, with two Bloom filters before any shuffle of lines.

A line's key is the line without the blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least ``MIN_CHARS`` code points found in at least
``MIN_DOCS`` documents lose all their lines, except in the largest doc_id that
holds them.

1. Every task hashes its keys, once per document, and sends the 64-bit hashes
   to the filter part that owns them (8 bytes a line, packed; hashes that a
   task saw in two documents are marked).  A part holds two Bloom filters: a
   hash already in the first one enters the second, and is handed out as
   suspected.  Filters are as large as the corpus needs, spread over the parts,
   one part at a time in a task; they never travel.
2. The suspected hashes fill one small bit filter, which the second pass over
   the lines uses: only lines that pass it are named exactly (128-bit BLAKE2 of
   the key) and shuffled, and of each key a task sends no more than its
   MIN_DOCS largest documents.  Those decide exactly: the key repeats if the
   merged list has MIN_DOCS documents, and its largest one keeps the lines.
3. The third pass drops lines by lookup in the repeated keys, or by a shuffle
   join on them where they are more than ``broadcast_keys``.

A full bit filter only lets more lines through to step 2; results stay the same.

Defined cases: null and empty texts are one empty line; a row without a doc_id
is no document: it counts for no key and keeps its lines; rows that share a
doc_id are one document; repeated rows get equal results; a text whose lines
all go is empty; an empty table gives no rows; other columns pass through
``clean`` and are ignored by ``digest``.
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
from .textops import column_bytes, fresh, mix64, row_chunks, small_batches, word_hashes

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_KEY = 16
FLUSH = 500_000                 # keys held by a task before it sends them on
BROADCAST_KEYS = 500_000        # 32 bytes each

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """The lines of a column slice: ``start``, ``end``, ``row``, and of the long enough keys the line
    number ``at``, the place ``lo:hi`` and the hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, min_chars: int):
        feeds = np.flatnonzero(data == 10)
        self.start = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
        self.end = np.sort(np.concatenate([feeds, off[1:]]), kind="stable")
        seen = np.searchsorted(feeds, off)
        self.count = np.diff(seen) + 1
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        solid = np.flatnonzero(~_BLANK[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = np.flatnonzero(b > a)
        lo, hi = solid[a[some]], solid[b[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[hi] - points[lo] >= min_chars
        self.at, self.lo, self.hi = some[long], lo[long], hi[long]
        self.folded = _LOWER[data]
        self.hash = word_hashes(self.folded, self.lo, self.hi)

    def exact(self, i: int) -> bytes:
        return hashlib.blake2b(self.folded[self.lo[i]:self.hi[i]].tobytes(), digest_size=16).digest()


def _slices(batches: Iterator[pa.RecordBatch], text: int):
    for b in batches:
        _, off = column_bytes(b.column(text))
        for lo, hi in row_chunks(off):
            part = b.slice(lo, hi - lo)
            yield part, *column_bytes(part.column(text))


class TwoFilters:
    """Bloom filters (two places a hash) of the hashes seen once and seen twice."""

    def __init__(self, keys: int):
        size = 1 << max(10, int(BITS_PER_KEY * max(1, keys)).bit_length() - 1)
        self.mask = np.uint64(size - 1)
        self.once, self.twice = np.zeros(size, bool), np.zeros(size, bool)

    def add(self, h: np.ndarray, again: bool) -> np.ndarray:
        """The hashes newly seen twice.  ``h``: distinct; ``again``: each was met twice already."""
        x, y = h & self.mask, mix64(h) & self.mask
        seen = np.ones(len(h), bool) if again else self.once[x] & self.once[y]
        self.once[x] = self.once[y] = True
        fresh_ = seen & ~(self.twice[x] & self.twice[y])
        self.twice[x[fresh_]] = self.twice[y[fresh_]] = True
        return h[fresh_]


def suspects(docs: DataFrame, parts: int, keys_per_part: int, min_chars: int) -> DataFrame:
    """(h): hashes of keys that are possibly in two documents; no repeated key is missing."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for again in (False, True):
                mine = h[(n > 1) == again]
                part = (mine >> shift).astype(np.int64)
                cut = np.flatnonzero(np.diff(part)) + 1
                groups = [g for g in np.split(mine, cut) if len(g)]
                if groups:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(g[0] >> shift) for g in groups], pa.int32()), pa.array([again] * len(groups)),
                         pa.array([g.tobytes() for g in groups], pa.binary())], names=["part", "again", "h"])

        for _, data, off in _slices(batches, 0):
            x = Lines(data, off, min_chars)
            row = x.row[x.at]
            o = np.lexsort((x.hash, row))
            h, row = x.hash[o], row[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            held.append(h[new])
            size += int(new.sum())
            if size > FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters = None, None
        for b in batches:
            for part, again, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now:
                    now, filters = part, TwoFilters(keys_per_part)
                out = filters.add(np.frombuffer(blob.as_buffer(), np.uint64), again)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(gather, "part int, again boolean, h binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(sift, "h long")


def repeated_keys(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
    """((h, k, keep) of every repeated key, written; the suspects' bit filter as a broadcast)."""
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    keys = total // (2 * min_chars) + 1                 # a few blanks and short lines among them
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys >> 20, 2)
    parts = 1 << (wanted - 1).bit_length()
    hashes = written(suspects(docs, parts, max(1, keys // parts), min_chars).distinct(), "suspects")
    shared = spark.sparkContext.broadcast(membership(hashes, hashes.count()))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k = np.frombuffer(b"".join(k for _, ks, _ in held for k in ks), np.uint64).reshape(-1, 2)
            h = np.concatenate([h for h, _, _ in held])
            doc = np.concatenate([d for _, _, d in held])
            held.clear()
            o = np.lexsort((-doc, k[:, 1], k[:, 0], h))
            h, k, doc = h[o], k[o], doc[o]
            key = np.ones(len(h), bool)
            key[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]).any(axis=1)
            new = key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            h, k, doc, key = h[new], k[new], doc[new], key[new]
            first = np.maximum.accumulate(np.where(key, np.arange(len(key)), 0))
            top = np.arange(len(key)) - first < min_docs
            return pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array([x.tobytes() for x in k[top]], pa.binary()), pa.array(doc[top])],
                                              names=["h", "k", "doc"])

        for b, data, off in _slices(batches, 1):
            x = Lines(data, off, min_chars)
            hit = np.flatnonzero(in_filter(*shared.value, x.hash))
            if len(hit):
                held.append((x.hash[hit], [x.exact(i) for i in hit], b.column(0).to_numpy()[x.row[x.at[hit]]]))
                size += len(hit)
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    named = (docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
                 .mapInArrow(name, "h long, k binary, doc long"))
    found = (named.groupBy("h", "k", "doc").agg(F.lit(1).alias("one")).groupBy("h", "k")
                  .agg(F.count("*").alias("n"), F.max("doc").alias("keep")).filter(F.col("n") >= min_docs).select("h", "k", "keep"))
    return written(found, "repeated"), shared


def _cut(text: bytes, x: Lines, first: int, gone: np.ndarray) -> bytes:
    """The lines of one row without those marked."""
    return b"\n".join(text[x.start[i]:x.end[i]] for i in range(first, first + len(gone)) if not gone[i - first])


FIELDS = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]


def _results(data: np.ndarray, off: np.ndarray, x: Lines, gone: np.ndarray, text: pa.Array) -> list[pa.Array]:
    first = np.cumsum(x.count) - x.count
    dropped = np.add.reduceat(gone, first) if len(first) else np.zeros(0, np.int64)
    kept = text.fill_null("").cast(pa.large_string())
    touched = np.flatnonzero(dropped)
    if len(touched):
        raw, new = data.tobytes(), kept.to_pylist()
        for r in touched:
            new[r] = _cut(raw, x, first[r], gone[first[r]:first[r] + x.count[r]]).decode()
        kept = pa.array(new, pa.large_string())
    return [pa.array(x.count, pa.int64()), pa.array(dropped, pa.int64()), kept.cast(pa.string())]


def dedup(spark: SparkSession, docs: DataFrame, keep: list[str], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``keep`` columns of every row of ``docs`` plus n_lines, n_dropped and kept (the text that stays).

    ``docs`` needs doc_id and text; a kept column with the name of a result gives way to the result.
    """
    keys, shared = repeated_keys(spark, docs, min_chars, min_docs)
    me, lost = fresh("doc", docs.columns), fresh("lost", docs.columns)
    src = docs.withColumn(me, F.col("doc_id").cast("long"))
    if keys.count() <= broadcast_keys:
        table = keys.orderBy("h", "k").toArrow()
        h = table.column("h").to_numpy().view(np.uint64)
        o = np.argsort(h, kind="stable")
        most = int(np.unique(h, return_counts=True)[1].max()) if len(h) else 0         # keys of one hash: 1, but for collisions
        known = spark.sparkContext.broadcast((h[o], [table.column("k")[i].as_py() for i in o], table.column("keep").to_numpy()[o], most))

        def kernel(col: pa.Array, doc: np.ndarray) -> list[pa.Array]:
            hashes, exact, owner, same = known.value
            data, off = column_bytes(col)
            x = Lines(data, off, min_chars)
            gone = np.zeros(len(x.row), np.int64)
            for step in range(same):
                at = np.searchsorted(hashes, x.hash) + step
                place = np.minimum(at, len(hashes) - 1)
                for i in np.flatnonzero((at < len(hashes)) & (hashes[place] == x.hash)):
                    d = doc[x.row[x.at[i]]]
                    if d is not None and d != owner[place[i]] and exact[place[i]] == x.exact(i):
                        gone[x.at[i]] = 1
            return _results(data, off, x, gone, col)

        return _with_side(src, keep, me, "bigint", kernel)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in _slices(batches, 2):
            x = Lines(data, off, min_chars)
            hit = np.flatnonzero(in_filter(*shared.value, x.hash))
            row = x.row[x.at[hit]]
            first = np.cumsum(x.count) - x.count
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((x.at[hit] - first[row]).astype(np.int32)),
                 pa.array(x.hash[hit].view(np.int64)), pa.array([x.exact(i) for i in hit], pa.binary())], names=["doc", "tag", "line", "h", "k"])

    tag = fresh("tag", src.columns)
    src = src.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = (src.filter(F.col(me).isNotNull()).select(F.col(me).alias("doc"), F.col(tag).alias("tag"), "text")
                .mapInArrow(lines, "doc long, tag long, line int, h long, k binary"))
    lists = (named.join(keys, ["h", "k"]).filter("doc <> keep").groupBy(F.col("doc").alias(me), F.col("tag").alias(tag))
                  .agg(F.collect_set("line").alias(lost)))           # no longer than their document

    def listed(col: pa.Array, side: list) -> list[pa.Array]:
        data, off = column_bytes(col)
        x = Lines(data, off, min_chars)
        gone = np.zeros(len(x.row), np.int64)
        first = np.cumsum(x.count) - x.count
        for r, at in enumerate(side):
            if at is not None:
                gone[first[r] + np.array(at)] = 1
        return _results(data, off, x, gone, col)

    return _with_side(src.join(lists, [me, tag], "left"), keep, lost, "array<int>", listed)


def _with_side(df: DataFrame, keep: list[str], side: str, kind: str, kernel) -> DataFrame:
    """``keep`` plus FIELDS; ``kernel`` gets a slice of the texts and the values of column ``side``."""
    new = {f.name for f in FIELDS}
    keep = [c for c in keep if c not in new]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in keep] + FIELDS)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in _slices(batches, len(names) - len(FIELDS)):
            made = kernel(b.column(len(keep)), b.column(len(keep) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names=names)

    cols = [df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)]
    return df.select(*cols, df["text"].alias("t"), df[f"`{side}`"].cast(kind).alias("s")).mapInArrow(run, schema)


def clean(spark: SparkSession, docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the repeated lines gone from the text; n_chars, if there, follows the new text."""
    cols = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") if c not in ("doc_id", "text") else F.col(c) for i, c in enumerate(cols)])
    out = dedup(spark, safe, safe.columns, **limits)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    made = {"text": text, "doc_id": F.col("doc_id")}
    if "n_chars" in cols:
        old = F.col(f"c{cols.index('n_chars')}")
        made["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return out.select(*[made.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])


def digest(spark: SparkSession, docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    out = dedup(spark, docs.select("doc_id", "text"), ["doc_id"], **limits)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest for every row of documents."""
    return digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) x) y),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
bad AS (SELECT k, max(doc_id) AS keep FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.keep <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.keep IS NULL OR b.keep = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN bad b ON b.k = k.k GROUP BY k.doc_id"""
