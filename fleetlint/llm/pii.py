"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans (always reported), leftmost non-overlapping per kind: ``email``,
``ip`` (parts at most 255), ``card`` (12 to 19 digits passing Luhn), ``phone`` (``+``,
9 to 15 digits).  They are the seeds.

The method adds identifiers the patterns above miss.  Every candidate token
(a run of non-blanks holding a digit or ``@``, no base span) and every base
span is an instance; the one and the two words before it are its lexical
patterns.  On the graph of distinct (pattern, instance) edges of the whole
corpus Spark repeats ``ROUNDS`` times: a pattern's confidence for a kind is the
sum of its instances' scores for that kind over its instances plus one; an
instance's score is the noisy-or of its patterns' confidences (seeds keep
score 1 for their kind).  A pattern counts only if at least ``SUPPORT`` seeds of
the kind stand in it.  Candidates scoring ``ACCEPT`` or more are reported as
``ctx_<kind>`` in every place where one of their confident patterns stands
before them.

Defined cases: null text is the empty text; repeated rows are reported alike
and count once in the graph; a null doc_id is its own document; with no seeds
nothing is added; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import cut_points, joined, row_key, sha, tagged, with_matches, written

# The rules of the contract; the look-behinds only keep a failing run from being tried at each of its
# characters (\G: right after the previous match), the possessive loops only keep it from being retried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = {"token": r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"}
KINDS = list(BASE) + [f"ctx_{k}" for k in BASE]
CONTEXT = 48                    # code points of the longest word that a pattern may hold
ROUNDS = 3
SUPPORT = 3
ACCEPT = 0.8


def located(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the text ``_t`` and the valid base spans of every kind."""
    out = with_matches(docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), "_t", BASE)
    digits = lambda x: F.regexp_replace(x["m"], "[^0-9]", "")
    small = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
    fits = lambda p: small(p) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255)
    out = out.withColumn("ip", F.filter("ip", lambda x: F.forall(F.split(x["m"], r"\."), fits)))
    out = out.withColumn("card", F.filter("card", lambda x: F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x))))
    return out.withColumn("phone", F.filter("phone", lambda x: F.length(digits(x)).between(9, 15)))


def instances(found: DataFrame) -> DataFrame:
    """(key, s, e, kind, value, patterns) of all base spans (kind set) and candidate tokens (kind null).

    Candidates that overlap a base span are left out; the neighbours are found by running windows over a text's spans.
    The words before a span are read from the code points before it that hold two longest words: a word that is
    cut there, or has more than CONTEXT code points, is no part of a pattern."""
    names = F.array(*[F.lit(k) for k in BASE])
    base = F.transform(tagged(list(BASE)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("kind")))
    some = with_matches(found.filter("_t is not null").select("key", "_t", base.alias("_base")), "_t", TOKEN)
    every = F.concat("_base", F.transform("token", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("string").alias("kind"))))
    width = F.lit(2 * (CONTEXT + 1) + 1)

    def read(piece) -> Column:
        return F.transform(every, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.lower(piece(x["s"], x["e"] - x["s"])).alias("value"),
            F.lower(piece(F.greatest(F.lit(0), x["s"] - width), F.least(x["s"], width))).alias("before")))

    rows = some.select("key", F.explode(cut_points(F.col("_t"), read)).alias("x")).select("key", "x.*")
    # two frames that only grow, one in each direction
    before, behind = (Window.partitionBy("key").orderBy(*[c(x) for x in ("s", "e", "kind")]).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc, F.desc))
    is_base = F.col("kind").isNotNull()
    last, after = F.max(F.when(is_base, F.col("e"))).over(before), F.min(F.when(is_base, F.col("s"))).over(behind)
    rows = rows.withColumn("_last", last).withColumn("_next", after)
    rows = rows.filter(is_base | ~(F.coalesce(F.col("_last") > F.col("s"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("e"), F.lit(False))))
    # the first piece is a whole word only if the text, or a blank, comes before it
    split = F.split("before", r"[\x20\x09-\x0D]+")
    whole = F.when(F.col("s") > width, F.slice(split, F.lit(2), F.size(split))).otherwise(split)
    short = F.filter(whole, lambda w: w != "")
    w1, w2 = F.try_element_at("w", F.lit(-1)), F.try_element_at("w", F.lit(-2))
    fits = lambda w: F.length(w) <= CONTEXT
    return (rows.withColumn("w", short)
                .withColumn("patterns", F.array_distinct(F.array_compact(F.array(F.when(fits(w1), w1), F.when(fits(w1) & fits(w2), F.concat_ws(" ", w2, w1))))))
                .select("key", "s", "e", "kind", "value", "patterns"))


def confident(inst: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scored graph: (pattern, kind, conf) of supported patterns, (value, kind, score) of candidates."""
    edges = written(inst.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "pii-edges")
    seeds = edges.filter("kind is not null")
    support = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n_seed")).filter(F.col("n_seed") >= SUPPORT)
    size = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    useful = written(support.join(size, "pattern"), "pii-patterns")
    open_edges = edges.filter("kind is null").select("pattern", "value").join(useful.select("pattern").distinct(), "pattern", "left_semi")
    open_edges = written(open_edges, "pii-open")
    pats = written(useful.withColumn("conf", F.col("n_seed") / (F.col("n") + 1)), "pii-conf")
    scores = None
    for _ in range(ROUNDS):
        scores = written(open_edges.join(pats, "pattern").groupBy("value", "kind")
                         .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score")), "pii-scores")
        gained = open_edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("gain"))
        pats = written(useful.join(gained, ["pattern", "kind"], "left")
                       .withColumn("conf", (F.col("n_seed") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)), "pii-conf")
    return pats, scores


def discovered(inst: DataFrame) -> DataFrame:
    """Reported contextual spans as (key, ctx: sorted (s, k, e) structs)."""
    pats, scores = confident(inst)
    good = scores.filter(F.col("score") >= ACCEPT)
    places = (inst.filter("kind is null").select("key", "s", "e", "value", F.explode("patterns").alias("pattern"))
                  .join(good, "value").join(pats.filter(F.col("conf") >= ACCEPT / 2).select("pattern", "kind"), ["pattern", "kind"], "left_semi"))
    number = F.array_position(F.array(*[F.lit(k) for k in BASE]), F.col("kind")).cast("int") - 1 + len(BASE)
    return (places.select("key", "s", number.alias("k"), "e").distinct()
                  .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("ctx")))


def scan(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, its base spans per kind and all reported spans."""
    found = located(docs.select("doc_id", "text", row_key("doc_id", "text").alias("key")))
    any_base = F.expr(" or ".join(f"size({k}) > 0" for k in BASE))
    has = any_base | F.col("_t").rlike("[0-9@]")
    slim = written(found.select("doc_id", "key", *BASE, F.when(has, F.col("_t")).alias("_t")), "pii")
    inst = written(instances(slim.dropDuplicates(["key"])), "pii-instances")
    out = slim.select("doc_id", "key", *BASE, tagged(list(BASE)).alias("base")).join(discovered(inst), "key", "left")
    return out.withColumn("all", F.when(F.col("ctx").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "ctx"))))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest per document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                      sha(joined(F.col("base"), KINDS)).alias("base_sha256"), joined(F.col("all"), KINDS).alias("spans"))
