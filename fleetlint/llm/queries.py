"""Queries of the numbered operators and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, linededup, lmscore, mixing, oracles, periodic, pii, quality, secrets, setjoin, suffixdedup, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": secrets.op1,
    "op2_pii": pii.op2,
    "op3_learned_partition_search": ann.op3,
    "op4_ngram_jaccard_join": setjoin.op4,
    "op5_lm_scoring": lmscore.op5,
    "op6_benchmark_decontamination": decontaminate.op6,
    "op7_toxicity": toxicity.op7,
    "op8_suffix_array_dedup": suffixdedup.op8,
    "op9_quality": quality.op9,
    "op10_source_mixing": mixing.op10,
    "op11_periodic_runs": periodic.op11,
    "op12_line_dedup": linededup.op12,
    "op13_spelling_variants": variants.op13,
}

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": oracles.JOIN,
    "op6_benchmark_decontamination": oracles.PASSAGES,
    "op8_suffix_array_dedup": oracles.REPEATS,
    "op10_source_mixing": mixing.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_line_dedup": linededup.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}
