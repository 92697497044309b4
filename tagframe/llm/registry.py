"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, fill_in_middle, hard_negatives, html_text, language_id, media_avi, minhash_dedup, mixing, quality, sentencepieces, suffix_dedup, token_counts, url_filters

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_html_text": html_text.query,
    "op3_url_filters": url_filters.query,
    "op4_minhash_dedup": minhash_dedup.query,
    "op5_quality": quality.query,
    "op6_language_id": language_id.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_media_avi": media_avi.query,
    "op9_sentencepieces": sentencepieces.query,
    "op10_token_counts": token_counts.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_fill_in_middle": fill_in_middle.query,
}

ORACLE_SQL = {
    "op3_url_filters": url_filters.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
