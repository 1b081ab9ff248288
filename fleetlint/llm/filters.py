"""A bit filter over 64-bit names: built distributed, of bounded size, for use before an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = (20, 28)          # smallest and largest size, as powers of two (at most 32 MB)


def membership(ranks: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit filter over the ranks (column h), built distributed by filter part; at most 2**28 bits (32 MB)."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], int(8 * max(1, n)).bit_length()))
    part_bits = 17
    parts = 1 << max(0, bits - part_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(1).to_numpy()
            p = b.column(0).to_numpy()
            o = np.argsort(p, kind="stable")
            for i in np.split(o, np.flatnonzero(np.diff(p[o])) + 1):
                if len(i):
                    m = maps.setdefault(int(p[i[0]]), np.zeros(1 << part_bits, np.uint8))
                    m[x[i]] = 1
        for p, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(m).tobytes()], pa.binary())], names=["part", "bits"])

    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (ranks.select(F.shiftright(place, part_bits).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << part_bits) - 1)).cast("int").alias("x"))
                 .repartition(min(parts, 256), "part").mapInArrow(run, "part int, bits binary").collect())
    out = np.zeros((parts, 1 << (part_bits - 3)), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1), bits


def in_filter(f: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    x = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (f[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
