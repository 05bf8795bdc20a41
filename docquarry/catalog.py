"""All queries of the engine's core, with their DuckDB counterparts."""

from __future__ import annotations

from docquarry.plans import assembly, composition, consistency, documents, evidence, extraction, payloads, pipelines, relational, rules, scans, streams, templates
from docquarry.plans.query import narrowed, widened

PARTS = (documents.Q, extraction.Q, pipelines.Q, relational.Q, streams.Q, assembly.Q, rules.Q, evidence.Q, templates.Q, payloads.Q, consistency.Q, scans.Q, composition.Q)
#: Lengths, places and ranks, which are 32-bit in Spark and 64-bit in DuckDB.
WIDE = {
    "a1_line_scan": ("pos",), "a3_fragment_merge": ("page", "page_end"), "a8_section_scan": ("start_block", "end_block"), "a14_page_scan": ("n",), "a17_preview": ("bars",),
    "c4_lookup_topn": ("n",), "c15_next_bounded": ("next_click",), "c20_quote_block": ("score",), "d21_preamble_bounds": ("lo", "hi"),
    "e12_gap_close": ("lo", "hi"), "f1_topk": ("n",), "f2_multi_key_order": ("place",), "h17_char_count": ("n",),
    "k7_keywords": ("n",), "t4_best_anchor": ("score",),
}
QUERIES = {name: widened(plan, WIDE[name]) if name in WIDE else plan for part in PARTS for name, plan in part.plans.items()}
ORACLES = {name: narrowed(text) for part in PARTS for name, text in part.oracles.items()}
FLAGSHIP = "retrieval_bm25_topk"
