"""Located regex matches and span digests as DataFrame expressions (no Python in the plan).

Positions are code points, ends exclusive.  A match list comes from
``regexp_extract_all``; its positions follow from the pieces that ``split``
leaves between the same matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session

SPAN = "array<struct<s:int,e:int,m:string>>"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back (cuts the lineage);
    ``session.clear_scratch`` deletes what an application has written."""
    return session.written(df, name)


def release(spark) -> None:
    """Let Spark drop the shuffle files and broadcasts of finished steps now: it does so when the driver's unused
    objects are collected, which a driver with memory to spare puts off."""
    import gc
    from .textops import give_back
    gc.collect()
    give_back()                                 # the driver's own Python, too
    spark.sparkContext._jvm.System.gc()


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn``'s lambdas use it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def running(values: Column, op, zero: Column) -> Column:
    """Array of ``op`` over all earlier values (``zero`` for the first one).

    Arrays grow by copying, so the values are taken in blocks of about the square root of their number:
    a text of 100,000 matches copies some ten million numbers, not some billions."""
    def fold(xs: Column, start: Column) -> Column:
        seed = F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(xs, seed, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / step).cast("int") - 1), lambda b: F.slice(xs, b * step + 1, step))

    def whole(xs: Column) -> Column:
        return bound(blocks(xs), lambda bs: F.flatten(F.zip_with(
            bs, fold(F.transform(bs, lambda x: F.aggregate(x, zero, op)), zero), fold)))

    return bound(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(xs))


def cut_points(text: Column, fn) -> Column:
    """``fn`` of a function (start, length in code points) -> piece of the text, that does not search for its place."""
    wide = lambda u: lambda at, n: F.decode(F.substr(u, at * 4 + 1, n * 4), "UTF-32")
    return bound(F.encode(text, "UTF-32"), lambda u: fn(wide(u)))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One column per pattern name: its leftmost non-overlapping matches as ``SPAN`` arrays."""
    cols = df.columns
    hits = df.select("*", *[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()])
    cut = hits.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.split(F.col(text), p, -1)).alias(f"_p_{k}") for k, p in patterns.items()])

    def placed(k: str) -> Column:
        def counted(m: Column) -> Column:
            # lengths of the pieces before the matches; the last piece follows them all
            return bound(F.transform(F.slice(F.col(f"_p_{k}"), 1, F.size(m)), F.length), lambda gaps: spans(m, gaps))

        def spans(m: Column, gaps: Column) -> Column:
            size = F.zip_with(gaps, m, lambda g, x: g + F.length(x))
            return bound(running(size, lambda a, b: a + b, F.lit(0)), lambda at: F.transform(m, lambda x, i: F.struct(
                (F.get(at, i) + F.get(gaps, i)).alias("s"), (F.get(at, i) + F.get(gaps, i) + F.length(x)).alias("e"), x.alias("m"))))

        return F.when(F.size(f"_m_{k}") > 0, bound(F.col(f"_m_{k}"), counted)).otherwise(F.expr(f"cast(array() as {SPAN})"))

    return cut.select(*cols, *[placed(k).alias(k) for k in patterns])


def tagged(kinds: list[str]) -> Column:
    """All spans of the kind columns as sorted structs (s, k, e): by start, then kind as listed."""
    def numbered(i: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

    parts = [F.transform(F.col(k), numbered(i)) for i, k in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def joined(sorted_spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of sorted (s, k, e) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(sorted_spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every run of overlapping (s, e) spans, sorted by start, replaced by ``mark``."""
    def pieces(piece, xs: Column, upto: Column) -> Column:
        inner = F.transform(xs, lambda x, i: F.when(x["s"] >= F.get(upto, i), F.concat(piece(F.get(upto, i), x["s"] - F.get(upto, i)), F.lit(mark))).otherwise(F.lit("")))
        end = F.greatest(F.element_at(upto, -1), F.element_at(xs, -1)["e"])
        return F.concat(F.array_join(inner, ""), piece(end, F.length(text) - end))

    def cut(piece) -> Column:
        return bound(spans, lambda xs: bound(running(F.transform(xs, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0)),
                                             lambda upto: pieces(piece, xs, upto)))

    return F.when(F.size(spans) > 0, cut_points(text, cut)).otherwise(text)


def row_key(doc_id: str, text: str) -> Column:
    """Equal for repeated rows only: document id and whole text."""
    return F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
