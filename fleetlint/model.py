"""Findings data model: severities and the uniform findings row.

A check returns a *facts* frame: the scope keys, ``object_name``,
``severity`` and its own scalar fact columns.  ``to_findings`` turns it into
the uniform findings shape; fact columns become the ``metadata`` map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRITICAL, WARNING, CONSIDER, INFO = "CRITICAL", "WARNING", "CONSIDER", "INFO"
# Severity order CRITICAL < WARNING < CONSIDER < INFO.
SEVERITY_RANK = {CRITICAL: 0, WARNING: 1, CONSIDER: 2, INFO: 3}
SEVERITIES = [CRITICAL, WARNING, CONSIDER, INFO]


def severity_rank(col: Column | str = "severity") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for name, rank in SEVERITY_RANK.items():
        expr = (F.when(c == name, F.lit(rank)) if expr is None else expr.when(c == name, F.lit(rank)))
    return expr.cast("tinyint")


FINDING_FIELDS = [
    T.StructField("check_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("severity_rank", T.ByteType(), True),
    T.StructField("object_name", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("detail", T.StringType(), True),
    T.StructField("remediation", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
]
FINDING_COLUMNS = [f.name for f in FINDING_FIELDS]


def findings_schema(keys: list[str]) -> T.StructType:
    key_fields = [T.StructField(k, T.LongType(), True) for k in keys]
    return T.StructType(key_fields + FINDING_FIELDS)


def _meta_value(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def to_findings(spec, facts: DataFrame, keys: list[str], remediation_when: Column | None = None) -> DataFrame:
    """Render a facts frame of one check into the uniform findings shape.

    ``remediation_when`` (a condition over the facts columns) keeps the
    remediation text only on findings that carry one."""
    fact_cols = [c for c in facts.columns if c not in set(keys) | {"object_name", "severity"}]
    pairs = []
    for c in fact_cols:
        pairs += [F.lit(c), _meta_value(facts, c)]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    title = spec.title() if spec.title else F.lit(spec.description)
    # without a text of its own, a finding tells its facts
    told = [F.when(_meta_value(facts, c).isNotNull() & (_meta_value(facts, c) != ""), F.concat(F.lit(c.replace("_", " ") + ": "), _meta_value(facts, c))) for c in fact_cols]
    named = F.concat(F.lit(spec.description + ". Object: "), F.col("object_name").cast("string"))
    detail = spec.detail() if spec.detail else F.concat_ws("; ", named, *told)
    remediation = spec.remediation() if spec.remediation else F.lit(None).cast("string")
    if remediation_when is not None:
        remediation = F.when(remediation_when, remediation)
    return facts.select(
        *[F.col(k).cast("bigint").alias(k) if k == "instance_id" else F.col(k) for k in keys],
        F.lit(spec.name).alias("check_name"),
        F.lit(spec.category).alias("category"),
        F.col("severity"),
        severity_rank("severity").alias("severity_rank"),
        F.col("object_name").cast("string").alias("object_name"),
        title.alias("title"),
        detail.alias("detail"),
        remediation.alias("remediation"),
        meta.alias("metadata"),
    )
