"""The corpus queries and their DuckDB equivalents."""

from __future__ import annotations

from . import chat_format, decontamination, license_scan, ngram_join, pii, piece_tokens, prefix_trie, quality_rules, ranked_search, secret_scan, source_mix, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_pii": pii.op5_pii,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_source_mix": source_mix.op7_source_mix,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_sentence_pieces": piece_tokens.op12_sentence_pieces,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests hold the others against brute force."""
    return {"op1_secret_scan": secret_scan.oracle(), "op3_license_scan": license_scan.oracle(), "op4_chat_format": chat_format.oracle(), "op7_source_mix": source_mix.oracle(), "op11_ranked_search": ranked_search.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
