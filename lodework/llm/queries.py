"""All queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, html_text, langid, near_dedup, packing, pieces, quality_rules, secrets, suffix_dedup, topk

_MODULES = (chat, langid, near_dedup, pieces, html_text, secrets, quality_rules, packing, topk, suffix_dedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
