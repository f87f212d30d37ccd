"""The registered queries of this package and their DuckDB text."""

from __future__ import annotations

from strata.llm import bytebpe, decontaminate, jaccard, licenses, mixing, pii, quality, tokens, toxicity, trie, urls, warc, whitening

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op1_ngram_jaccard_links": jaccard.links_query,
    "op2_license_scans": licenses.query,
    "op3_url_filters": urls.query,
    "op4_warc": warc.query,
    "op5_token_counts": tokens.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing_sources": mixing.query,
    "op8_quality_rules": quality.query,
    "op9_benchmark_decontamination": decontaminate.query,
    "op10_pii": pii.query,
    "op11_byte_bpe": bytebpe.query,
    "op12_embedding_whitening": whitening.query,
    "op13_prefix_trie": trie.query,
}

ORACLE = {
    "op1_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op1_ngram_jaccard_links": jaccard.ORACLE_SQL,
    "op3_url_filters": urls.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op13_prefix_trie": trie.ORACLE_SQL,
}
