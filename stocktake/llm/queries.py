"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bin_completion, filter_audit, language_id, license_scan, line_dedup, merkle_manifest, minhash_dedup, quality_rules, secret_scan, source_mix, suffix_dedup, threshold_topk, wavelet_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_secret_scan": secret_scan.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_minhash_dedup": minhash_dedup.query,
        "op5_source_mix": source_mix.query,
        "op6_quality_rules": quality_rules.query,
        "op7_best_fit_packing": bin_completion.query,
        "op8_license_scan": license_scan.query,
        "op9_wavelet_tokens": wavelet_tokens.query,
        "op10_threshold_topk": threshold_topk.query,
        "op11_language_id": language_id.query,
        "op12_filter_audit": filter_audit.query,
        "op13_merkle_manifest": merkle_manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op2_secret_scan": secret_scan.SQL,
        "op4_minhash_dedup": minhash_dedup.SQL,
        "op8_license_scan": license_scan.SQL,
        "op10_threshold_topk": threshold_topk.SQL,
        "op12_filter_audit": filter_audit.SQL,
        "op13_merkle_manifest": merkle_manifest.SQL,
    }
