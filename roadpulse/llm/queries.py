"""The queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from roadpulse.llm import (
    chat, embedding_dedup, hard_negatives, language_model, license_scan, mixing, packing, quality, ranked_search,
    sentence_pieces, simhash, topk, toxicity,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_lm_scoring": language_model.op5_lm_scoring,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_format_chats": chat.op9_format_chats,
    "op10_topk": topk.op10_topk,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
    "op9_format_chats": chat.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
