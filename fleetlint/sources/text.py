"""Text sources: server logs and schema dumps (src_log_lines, src_dump_text).

Files are read line by line, split across tasks, and every line gets its
true number in its file: its place inside its split plus the lines of the
splits before.  The place is the distance of ``monotonically_increasing_id``,
taken on the scan, from the split's first one, so only one row a split is
aggregated and no line is shuffled to be numbered.  Folder layout
``<root>/instance_id=<n>/...`` gives the instance column by partition discovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, root: str) -> DataFrame:
    """(partition columns..., file_id, block, line_no, line); ``block``: first byte of the line's split."""
    df = spark.read.option("basePath", root).option("lineSep", "\n").text(root)
    parts = [c for c in df.columns if c != "value"]
    lines = df.select(*parts, F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    splits = lines.groupBy("file_id", "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file_id").orderBy("block")) - F.col("__n")      # rows of one file: its splits
    at = splits.select("file_id", "block", (before - F.col("__first")).alias("__shift"))
    return lines.join(at, ["file_id", "block"]).select(
        *parts, "file_id", "block", (F.col("__id") + F.col("__shift") + 1).cast("bigint").alias("line_no"), "line")


def read_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """(instance_id?, file_id, block, line_no, line) for every line under ``root`` (1-based lines)."""
    return _numbered(spark, root)


def read_dump_lines(spark: SparkSession, root: str) -> DataFrame:
    """(instance_id?, file_id, line_no, line) for every dump file under ``root`` (1-based lines)."""
    return _numbered(spark, root).drop("block")
