"""The registered queries of this subpackage, each with its SQL or None.

All but two have none: they sort suffixes, pack, follow graphs, link intervals,
stream an automaton or learn. tests/llm holds them against brute force.
"""

from __future__ import annotations

from marketloom.llm import decontaminate, harmonic_packing, lexical_search, licenses, packing, prefix_trie, quality_model, quality_rules, secrets, simhash, suffix_dedup, toxicity, url_filter
from marketloom.llm.common import table

Q: dict = {
    "op1_suffix_dedup": (lambda spark, d: suffix_dedup.suffix_dedup_report(table(spark, d, "documents")), None),
    "op2_packing": (lambda spark, d: packing.pack(table(spark, d, "documents")), None),
    "op3_url_filter": (lambda spark, d: url_filter.filter_urls(table(spark, d, "pages")), None),
    "op4_secrets": (lambda spark, d: secrets.secrets_report(table(spark, d, "documents")), None),
    "op5_decontamination": (lambda spark, d: decontaminate.decontamination_report(table(spark, d, "documents"), table(spark, d, "benchmark")), None),
    "op6_quality_rules": (lambda spark, d: quality_rules.quality_report(table(spark, d, "documents")), None),
    "op7_simhash": (lambda spark, d: simhash.simhash_report(table(spark, d, "documents")), None),
    "op8_quality_model": (lambda spark, d: quality_model.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")), None),
    "op9_licenses": (lambda spark, d: licenses.license_report(table(spark, d, "documents")), None),
    "op10_toxicity": (lambda spark, d: toxicity.toxicity_report(table(spark, d, "documents"), table(spark, d, "labels")), None),
    "op11_lexical_search": (lambda spark, d: lexical_search.lexical_search(table(spark, d, "documents"), table(spark, d, "benchmark")), lexical_search.SEARCH_SQL),
    "op12_harmonic_packing": (lambda spark, d: harmonic_packing.pack_harmonic(table(spark, d, "documents")), None),
    "op13_prefix_trie": (lambda spark, d: prefix_trie.prefix_trie(table(spark, d, "conversations")), prefix_trie.TRIE_SQL),
}
