"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import importance, language, mixing, near_dedup, neighbours, piece_lattice, prefix_trie, quality_rules, rank_queue_bpe, secret_scan, token_counts, token_file, word_runs

QUERIES = {
    "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_importance_resampling": importance.op3_importance_resampling,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_sentencepiece": piece_lattice.op6_sentencepiece,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_token_files": token_file.op9_token_files,
    "op10_language_id": language.op10_language_id,
    "op11_word_runs": word_runs.op11_word_runs,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_byte_bpe": rank_queue_bpe.op13_byte_bpe,
}

ORACLE = {"op2_mix_sources": mixing.OP2_SQL, "op7_near_dedup": near_dedup.OP7_SQL, "op11_word_runs": word_runs.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
