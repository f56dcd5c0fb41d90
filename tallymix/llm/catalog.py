"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, fingerprints, jaccard_join, language, line_dedup, mixing, packing, private, quality, resampling, toxicity, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_quality": quality.op2_quality,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_private_data": private.op4_private_data,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_packing": packing.op6_packing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_language_id": language.op8_language_id,
        "op9_media_audio": audio.op9_media_audio,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op10_url_filter": url_filter.oracle_sql(url_filter.default_model()),
        "op12_vector_codes": vector_codes.ORACLE_SQL,
        "op13_importance_resampling": resampling.ORACLE_SQL,
    }
