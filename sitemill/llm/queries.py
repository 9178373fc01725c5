"""The queries of this subpackage and their SQL, as the driver's entry file registers them."""

from __future__ import annotations

from sitemill.llm import ann, bpe, chat_format, conversation_trie, embedding_dedup, language_id, near_dedup, packing, phrases, quality_rules, secret_scan, suffix_dedup, url_filters

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_packing": packing.op2_packing,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_language_id": language_id.op7_language_id,
    "op8_ann": ann.op8_ann,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_phrases": phrases.op11_phrases,
    "op12_embedding_near_dedup": embedding_dedup.op12_embedding_near_dedup,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

SQL = {
    "op9_near_dedup": near_dedup.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_embedding_near_dedup": embedding_dedup.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
