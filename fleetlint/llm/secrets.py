"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans (always reported), leftmost non-overlapping per kind:
``assign`` (a keyword, ``:`` or ``=``, a value of 8 or more characters), ``access``
(``AKIA`` and 12 or more capitals or digits), ``hex`` (32 or more hex digits).

The method adds weak candidates: ``weak_id`` (account, user or client names
and key ids), ``weak_secret`` (other secret-like assignments with short or
unusual values, and bare 40-character keys) and ``endpoint`` (URLs of
services).  Every part is a row (document, scope, role, start); scopes are
paragraphs (split at blank lines).  Inside each scope the parts are ordered by
place and joined with the nearest identifier and secret before and after them
(running windows over intervals, whatever their length): a weak identifier is
reported only with a secret in its scope, a weak secret only with an
identifier, an endpoint only with both.  ``reach`` narrows this to parts with at
most so many code points between the end of one and the start of the other.

Time grows with the text, not with the square of its matches: positions are
running sums (``spans.running``), pieces are cut without searching their place.

Defined cases: null text is the empty text (no spans); repeated rows are
reported alike; a null doc_id is its own document; extra columns are ignored by
the query and passed through by ``redact``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import joined, redacted, row_key, sha, tagged, with_matches, written

GAP = {"_gap": r"\n\x20*\n"}           # what separates the scopes (paragraphs) of a text
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",     # a shorter run fails whole, so the length can stand in the pattern
    "hex": r"[0-9a-f]{32,}",
}
WEAK = {
    "weak_id": r"""(?i:access_?key_?id|client_?id|account_?(?:name|id)|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+._-]{3,}""",
    "weak_secret": r"""(?i:pwd|passphrase|private_?key|access_?key|credential)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,}|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""",
    "endpoint": r"""(?i:https?|s?ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+""",
}
KINDS = list(BASE) + list(WEAK)
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier",
        "weak_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
MARK = "[SECRET]"


def located(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one span array per kind; assignments with short values are dropped."""
    clean = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = with_matches(clean, "_t", BASE | WEAK | GAP)
    value = lambda x: F.regexp_extract(x["m"], BASE["assign"], 1)
    return out.withColumn("assign", F.filter("assign", lambda x: F.length(value(x)) >= 8))


def linked(found: DataFrame, reach: int | None = None) -> DataFrame:
    """Reported weak candidates as (key, weak: sorted (s, k, e) structs).

    ``found``: key and the columns of ``located``.  The parts of a text are
    ordered by place; per scope, the nearest identifier and secret before and after each
    part come from running windows, so a part of any length and distance finds its
    complement.  ``reach``: the largest gap between linked parts in code points; None, the whole scope."""
    spans = F.transform(tagged(KINDS), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    gaps = F.transform("_gap", lambda g: F.struct(g["e"].alias("s"), F.lit(-1).alias("k"), g["e"].alias("e")))
    parts = (found.filter(" or ".join(f"size({k}) > 0" for k in WEAK)).select("key", F.explode(F.concat(spans, gaps)).alias("x"))
                  .select("key", "x.*").dropDuplicates(["key", "s", "k", "e"]))
    parts = parts.withColumn("scope", F.sum((F.col("k") < 0).cast("int")).over(Window.partitionBy("key").orderBy("s", "k")))
    parts = parts.filter("k >= 0").withColumn("role", F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("k") + 1))
    # frames that only grow: a frame up to the last row would be summed anew for every row
    scope = Window.partitionBy("key", "scope")
    before, after = (scope.orderBy(*[c(x) for x in ("s", "k", "e")]).rowsBetween(Window.unboundedPreceding, 0) for c in (F.asc, F.desc))

    def near(role: str):
        mine = F.col("role") == role
        last, first = F.max(F.when(mine, F.col("e"))).over(before), F.min(F.when(mine, F.col("s"))).over(after)
        if reach is None:
            return last.isNotNull() | first.isNotNull()
        return F.coalesce(F.col("s") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("e") <= reach, F.lit(False))

    seen = parts.withColumn("id", near("identifier")).withColumn("sec", near("secret"))
    good = seen.filter((F.col("k") >= len(BASE)) & (((F.col("role") == "identifier") & F.col("sec")) | ((F.col("role") == "secret") & F.col("id"))
                       | ((F.col("role") == "endpoint") & F.col("id") & F.col("sec"))))
    return good.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("weak"))


def scan(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """Every row's doc_id, its base spans and all reported spans, as sorted (s, k, e) structs."""
    found = located(docs.select("doc_id", "text", row_key("doc_id", "text").alias("key")))
    slim = written(found.select("doc_id", "key", *KINDS, "_gap"), "secrets")
    out = slim.select("doc_id", "key", *BASE, tagged(list(BASE)).alias("base")).join(linked(slim, reach), "key", "left")
    return out.withColumn("all", F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "weak"))))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest per document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                      sha(joined(F.col("base"), KINDS)).alias("base_sha256"), joined(F.col("all"), KINDS).alias("spans"))


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``docs`` with every reported span replaced by ``MARK``; n_chars, if there, follows the new text.

    The rows are written once with their spans, so that no text is searched twice.  Only rows with weak
    candidates take part in a join; all others are rewritten in place without a shuffle.
    """
    cols = docs.columns
    weak = F.expr(" or ".join(f"size({k}) > 0" for k in WEAK))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "doc_id", "text", row_key("doc_id", "text").alias("key"))
    found = written(located(rows).select("row", "key", *KINDS, "_gap"), "located").withColumn("text", F.col("row.text")).withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    plain = found.filter(~weak).withColumn("_all", tagged(list(BASE)))
    hard = found.filter(weak)
    hard = hard.join(linked(hard, reach), "key", "left").withColumn(
        "_all", F.array_sort(F.concat(tagged(list(BASE)), F.coalesce("weak", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")))))
    out = []
    for part in (plain, hard):
        part = part.withColumn("text", F.when(F.size("_all") > 0, redacted(F.col("_t"), F.col("_all"), MARK)).otherwise(F.col("text")))
        new = {"text": F.col("text")}
        if "n_chars" in cols:
            new["n_chars"] = F.when(F.size("_all") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out.append(part.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols]))
    return out[0].unionByName(out[1])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced (columns of documents; no document is dropped)."""
    return redact(docs)
