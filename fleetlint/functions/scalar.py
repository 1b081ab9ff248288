"""Scalar helpers.  Every one is a Spark built-in composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qualify(*parts: str | Column) -> Column:
    """``schema.name`` (r_project_qualify)."""
    return F.concat_ws(".", *[_c(p) for p in parts])


def lsn_to_bytes(lsn: str | Column) -> Column:
    """PostgreSQL LSN text ``X/Y`` (hex halves) to an exact byte position (F9).

    ``conv`` turns each hex half into decimal text; the high half is scaled by
    2^32 in DECIMAL(20,0), so the value stays exact beyond the double range.
    """
    s = _c(lsn)
    hi = F.conv(F.split_part(s, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.split_part(s, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return (hi * F.lit(4294967296).cast("decimal(20,0)") + lo).cast("decimal(20,0)")


def lsn_diff_bytes(a: str | Column, b: str | Column) -> Column:
    """``pg_wal_lsn_diff(a, b)`` in bytes, exact."""
    return (lsn_to_bytes(a) - lsn_to_bytes(b)).cast("decimal(21,0)")


def cut(text: str | Column, n: int) -> Column:
    """First ``n`` characters (the reference cuts bytes; characters never split a letter)."""
    return F.substring(_c(text), 1, n)


def trimmed_list(text: str | Column, sep: str = ",") -> Column:
    """Comma list to an array of trimmed, non-empty items (F4)."""
    return F.filter(F.transform(F.split(_c(text), sep), lambda x: F.trim(x)), lambda x: x != "")


def fmt_time(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
