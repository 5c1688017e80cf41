"""Queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from trackmill.llm import bpe, langid, licenses, neighbours, packing, passages, repair, repeats, simhash, sketches, toxicity, trie, urlfilter

QUERIES = {
    "op1_cross_polytope": neighbours.op1_cross_polytope,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_language": langid.op3_language,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_repeats": repeats.op5_repeats,
    "op6_bpe": bpe.op6_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_fingerprints": sketches.op8_fingerprints,
    "op9_passages": passages.op9_passages,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_repair": repair.op12_repair,
    "op13_toxicity": toxicity.op13_toxicity,
}
SQL = {**urlfilter.SQL, **licenses.SQL, **trie.SQL, **repair.SQL}
