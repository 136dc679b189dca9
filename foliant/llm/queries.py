"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language_model, merkle, minhash, mixing, packing, pieces, pii, quality_rules, resampling, suffix_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_pii": pii.op2_pii,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_language_model": language_model.op4_language_model,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_minhash": minhash.op8_minhash,
        "op9_packing": packing.op9_packing,
        "op10_warc": warc.op10_warc,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_source_mix": mixing.op12_source_mix,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op3_suffix_dedup": suffix_dedup.OP3_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op8_minhash": minhash.OP8_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_source_mix": mixing.OP12_SQL,
        "op13_importance_resampling": resampling.OP13_SQL,
    }
