"""The queries of this subpackage: name -> (query, DuckDB SQL or None)."""
from __future__ import annotations

from trapline.llm import decontaminate, jaccard, langid, language_model, mixing, negatives, passages, quality, sharding, sketches, suffixes, trie, urls

QUERIES = {
    "op1_url_filters": (urls.op1_url_filters, urls.OP1_SQL),
    "op2_mix_sources": (mixing.op2_mix_sources, mixing.OP2_SQL),
    "op3_language_id": (langid.op3_language_id, None),
    "op4_substring_dedup": (passages.op4_substring_dedup, None),
    "op5_benchmark_decontamination": (decontaminate.op5_benchmark_decontamination, decontaminate.OP5_SQL),
    "op6_suffix_array_dedup": (suffixes.op6_suffix_array_dedup, suffixes.OP6_SQL),
    "op7_quality_rules": (quality.op7_quality_rules, quality.OP7_SQL),
    "op8_lm_scoring": (language_model.op8_lm_scoring, None),
    "op9_shards": (sharding.op9_shards, None),
    "op10_ngram_jaccard_join": (jaccard.op10_ngram_jaccard_join, jaccard.OP10_SQL),
    "op11_minhash_dedup": (sketches.op11_minhash_dedup, sketches.OP11_SQL),
    "op12_hard_negatives": (negatives.op12_hard_negatives, negatives.OP12_SQL),
    "op13_conversation_trie": (trie.op13_conversation_trie, trie.OP13_SQL),
}
