"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language_id, mixing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_language_id": language_id.op4_language_id,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_simhash": simhash.op9_simhash,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Learned models, tokenizer merges, XXH64 and compression are beyond SQL; tests hold those queries against brute force."""
    return {
        "op3_quality_rules": quality_rules.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_mixing": mixing.SQL,
    }
