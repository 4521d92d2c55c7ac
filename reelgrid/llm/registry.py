"""The opN queries and their SQL."""

from __future__ import annotations

from reelgrid.llm import codes, exact_dedup, language, line_dedup, packing, pii, quality, setsketch, simhash, sketches, spelling, token_counts, unigram

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (exact_dedup, line_dedup, packing, token_counts, simhash, sketches, language, pii, quality, unigram, codes, spelling, setsketch):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
