"""Registered text queries and their SQL counterparts."""

from arborlake.llm import collocations, conversation_trie, decontamination, jaccard_join, packing, pii, quality_rules, sentencepiece_sampling, suffix_array_dedup, suffix_tree_dedup, toxicity, url_filters, warc

QUERIES = {
    "op1_warc_normaliser": warc.op1_warc_normaliser,
    "op2_pii_bootstrap": pii.op2_pii_bootstrap,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op3_sentencepiece_sampling": sentencepiece_sampling.op3_sentencepiece_sampling,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_array_dedup": suffix_array_dedup.op6_suffix_array_dedup,
    "op7_suffix_tree_dedup": suffix_tree_dedup.op7_suffix_tree_dedup,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_url_filters": url_filters.op9_url_filters,
    "op11_concatenate_and_cut": packing.op11_concatenate_and_cut,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLE = {
    "op1_warc_normaliser": warc.ORACLE,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_suffix_tree_dedup": suffix_tree_dedup.ORACLE,
    "op8_benchmark_decontamination": decontamination.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
