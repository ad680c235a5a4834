"""Registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from riskmap.llm import (decontaminate, exact_dedup, jaccard_join, language_id, language_model, merkle, pieces, pii,
                         quality, resampling, sharding, simhash, toxicity)

QUERIES = {
    "op1_pii": (pii.op1_pii, None),
    "op2_exact_dedup": (exact_dedup.op2_exact_dedup, exact_dedup.ORACLE),
    "op3_decontaminate": (decontaminate.op3_decontaminate, decontaminate.ORACLE),
    "op4_pieces": (pieces.op4_pieces, None),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_jaccard_join": (jaccard_join.op6_jaccard_join, None),
    "op7_language_model": (language_model.op7_language_model, None),
    "op8_quality": (quality.op8_quality, None),
    "op9_sharding": (sharding.op9_sharding, None),
    "op10_language_id": (language_id.op10_language_id, None),
    "op11_resampling": (resampling.op11_resampling, resampling.ORACLE),
    "op12_merkle": (merkle.op12_merkle, merkle.ORACLE),
    "op13_simhash": (simhash.op13_simhash, None),
}
