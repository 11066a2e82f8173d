"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from quillspark.llm import html_text, jaccard, lines, mixing, oracles, pii, prefixes, quality, simhash, suffixes, tiling, urls, warc, whitening

QUERIES = {
    "op1_find_pii": pii.op1,
    "op2_judge_urls": urls.op2,
    "op3_link_documents": jaccard.op3,
    "op4_quality_rules": quality.op4,
    "op5_extract_text": html_text.op5,
    "op6_remove_repeats": suffixes.op6,
    "op10_find_leaks": tiling.op10,
    "op7_dedup_lines": lines.op7,
    "op8_mix_sources": mixing.op8,
    "op9_arc_to_warc": warc.op9,
    "op11_prefix_trie": prefixes.op11,
    "op12_whiten": whitening.op12,
    "op13_simhash": simhash.op13,
}
ORACLES = {
    "op3_link_documents": oracles.OP3_SQL,
    "op6_remove_repeats": oracles.OP6_SQL,
    "op7_dedup_lines": lines.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_arc_to_warc": warc.OP9_SQL,
}
