"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, packing, pages, pii, quality, simhash, token_counts, token_store

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_html_extraction": pages.op3_html_extraction,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_packing": packing.op6_packing,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_token_store": token_store.op9_token_store,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {"op2_quality_rules": quality.SQL, "op7_chat_formatting": chat.SQL}
