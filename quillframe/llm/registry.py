"""The queries of the training-data operators and their oracles."""

from __future__ import annotations

from quillframe.llm import byte_pairs, fingerprints, langid, line_dedup, merkle, mixing, ngram_join, periodic_runs, pieces, preference, secrets, suffix_dedup, topk

QUERIES = {
    "op1_preference_pairs": preference.op1_preference_pairs,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sample_pieces": pieces.op3_sample_pieces,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_language_id": langid.op6_language_id,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_byte_pairs": byte_pairs.op12_byte_pairs,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op13_merkle_manifest": merkle.OP13_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op1_preference_pairs": preference.OP1_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
}
