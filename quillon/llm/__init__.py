"""Operators for training-data pipelines, and the queries that apply them to whole tables.

Nothing else in the package imports this subpackage.
"""

from __future__ import annotations

from quillon.llm import (
    decontaminate,
    language_id,
    line_dedup,
    packing,
    periodic_runs,
    piece_codec,
    quality,
    sharding,
    simhash,
    spelling_variants,
    substring_dedup,
    token_counts,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_shard": sharding.op2_shard,
        "op3_substring": substring_dedup.op3_substring,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_pack": packing.op5_pack,
        "op6_quality": quality.op6_quality,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_language": language_id.op10_language,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_piece_codec": piece_codec.op13_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_shard": sharding.OP2_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op11_periodic_runs": periodic_runs.OP11_SQL,
        "op12_spelling_variants": spelling_variants.OP12_SQL,
    }
