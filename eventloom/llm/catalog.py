"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from eventloom.llm import bpe, clustering, exact_dedup, exact_topk, html_text, mixing, passages, prefix_trie, quality, set_join, token_counts, token_store, url_filter

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_repeated_passages": passages.op2_repeated_passages,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_store": token_store.op4_token_store,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_exact_topk": exact_topk.op6_exact_topk,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_ngram_join": set_join.op8_ngram_join,
    "op9_bpe_coding": bpe.op9_bpe_coding,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_annulus_clusters": clustering.op11_annulus_clusters,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op5_source_mixing": mixing.SQL,
    "op6_exact_topk": exact_topk.SQL,
    "op7_url_filters": url_filter.SQL,
    "op8_ngram_join": set_join.SQL,
    "op11_annulus_clusters": clustering.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
