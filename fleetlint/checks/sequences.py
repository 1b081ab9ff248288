"""Sequence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import qualify
from .common import WARNING, facts_frame
from .registry import register_check

# Largest value of the small sequence types.
TYPE_MAX = {"smallint": 32767, "integer": 2147483647}


def _user_sequences(cat):
    return cat.with_namespace(cat["cat_sequence"], "relname") \
              .withColumn("fqn", qualify("nspname", "relname"))


@register_check("sequence_audit", "sequences", needs=("cat_sequence", "cat_namespace", "cat_class", "cat_attribute"),
                description="Every sequence needs a multi-node strategy",
                title=lambda: F.format_string("Sequence %s of type %s", F.col("object_name"), F.col("data_type")),
                remediation=lambda: F.lit("Convert to snowflake ids or give each node its own "
                                          "non-overlapping range."),
                offline=True)
def sequence_audit(cat):
    k = cat.keys
    s = _user_sequences(cat)
    owner_t = cat["cat_class"].select(*k, F.col("oid").alias("refobjid"), F.col("relname").alias("owner_table"))
    owner_c = cat["cat_attribute"].select(*k, F.col("attrelid").alias("refobjid"),
                                          F.col("attnum").alias("refobjsubid"), F.col("attname").alias("owner_column"))
    s = s.join(owner_t, k + ["refobjid"], "left").join(owner_c, k + ["refobjid", "refobjsubid"], "left")
    return facts_frame(s, k, F.col("fqn"), F.lit(WARNING), data_type=F.col("data_type"),
                       start_value=F.col("seqstart").cast("bigint"), increment=F.col("seqincrement").cast("bigint"),
                       max_value=F.col("seqmax").cast("bigint"), is_cycle=F.col("seqcycle"),
                       is_owned=F.col("refobjid").isNotNull(), owner_table=F.col("owner_table"),
                       owner_column=F.col("owner_column"))


@register_check("sequence_data_types", "sequences", needs=("cat_sequence", "cat_namespace"),
                description="smallint/integer sequences can run out of values",
                title=lambda: F.format_string("Sequence %s is a %s and ends at %d", F.col("object_name"),
                                              F.col("data_type"), F.col("type_max")),
                remediation=lambda: F.format_string("ALTER SEQUENCE %s AS bigint;", F.col("object_name")),
                offline=True)
def sequence_data_types(cat):
    s = _user_sequences(cat).filter(F.col("data_type").isin(*TYPE_MAX))
    tmax = F.when(F.col("data_type") == "smallint", F.lit(TYPE_MAX["smallint"])).otherwise(F.lit(TYPE_MAX["integer"]))
    return facts_frame(s, cat.keys, F.col("fqn"), F.lit(WARNING), data_type=F.col("data_type"),
                       max_value=F.col("seqmax").cast("bigint"), type_max=tmax.cast("bigint"))
