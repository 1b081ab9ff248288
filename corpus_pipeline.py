"""Corpus pipeline: five cleaning and mixing stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlint.llm import decontaminate, mixing, secrets, setjoin, toxicity
from fleetlint.llm.spans import release
from fleetlint.llm.textops import small_batches
from fleetlint.session import scratch_dir

#: rows of an Arrow batch of whole documents: all stages share the executors, which keep what a stage has used
BATCH_ROWS = 500


def _in_small_batches(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark, BATCH_ROWS)
        release(spark)                          # what the stage before has left behind
        return stage(spark, docs, sf_dir)

    run.__doc__ = stage.__doc__
    return run


STAGES = [
    ("toxicity", _in_small_batches(toxicity.stage)),
    ("ngram_jaccard_join", _in_small_batches(setjoin.stage)),
    ("benchmark_decontamination", _in_small_batches(decontaminate.stage)),
    ("secret_scans", _in_small_batches(secrets.stage)),
    ("source_mixing", _in_small_batches(mixing.stage)),
]

#: stages 1 (a trained network) and 2 (similarity classes) are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:                                   # the table before is of no use any more
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        docs = spark.read.parquet(path)
    return docs
