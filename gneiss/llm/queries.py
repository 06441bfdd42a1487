"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, line_dedup, minhash_dedup, mixing, mpeg_audio, periodic_runs, quality_rules, secret_scan, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_minhash_dedup": minhash_dedup.ORACLE,
}
