"""numpy kernels over Arrow text columns, and the Arrow map they run in.

Texts are handled as UTF-8 bytes; every word rule used here treats all
non-ASCII bytes alike, so byte words equal code-point words.  Null text is
the empty text.  Work is cut into chunks of whole rows of about
``CHUNK_BYTES``; one longer row is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_table(keep: Callable[[int], bool]) -> np.ndarray:
    """Byte -> folded byte (A-Z lowered); 0 for bytes outside words (byte 0 is never in a word)."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if b and keep(low):
            t[b] = low
    return t


#: lower-cased runs of letters, digits and non-ASCII characters
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(folded bytes, word starts, word ends, first word of each row plus the end)."""
    folded = table[data]
    inside = folded != 0
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return folded, z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)          # a row begins here
    cut[offsets[:-1]] = True
    cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        n = max(n, CHUNK_BYTES // 2 + 1)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same in every task: a polynomial over coded bytes, mixed."""
    out = np.empty(len(starts), np.uint64)
    lo, step = 0, CHUNK_BYTES // 2
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        p, inv = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_CODES[folded[a:b]] * p[:b - a], out=sums[1:], dtype=np.uint64)
        s = starts[lo:hi] - a
        out[lo:hi] = (sums[ends[lo:hi] - a] - sums[s]) * inv[s]
        lo = hi
    return mix64(out)


def give_back() -> None:
    """Hand freed memory back to the system.  Spark keeps its Python workers for later tasks, and an allocator keeps what
    they have freed; the memory is taken from whatever the executor runs next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)        # the GNU C library has it
    if trim is not None:
        trim(0)


def fresh(name: str, taken) -> str:
    """``name``, lengthened until no column in ``taken`` has it (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of whole texts hold ``rows`` rows instead of Spark's default number, so that
    long texts fit beside the heap; a smaller number that the session has stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) in (10000, BATCH_ROWS):
        spark.conf.set(name, str(rows if spark.conf.get(name) == "10000" else min(rows, BATCH_ROWS)))


def map_text(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
             kernel: Callable[[pa.Array], list[pa.Array]], limit: int = CHUNK_BYTES) -> DataFrame:
    """``df``'s ``keep`` columns plus ``fields`` computed by ``kernel`` from the text column.

    ``kernel`` gets a slice of whole rows and returns one Arrow array per
    field.  A kept column with the name of a field gives way to the field.
    Nothing is shuffled; memory is bounded by the Arrow batch and one chunk.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    src = [df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)] + [df[f"`{text}`"].alias("t")]
    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, types[c].dataType) for c in keep] + fields)
    names = [f.name for f in schema.fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(n_keep)
            _, off = column_bytes(col)
            for lo, hi in row_chunks(off, limit):
                made = kernel(col.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).slice(lo, hi - lo) for i in range(n_keep)] + made, names=names)
        give_back()

    return df.select(*src).mapInArrow(run, schema)
