"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, exact_dedup, language_id, mixing, near_dedup, packing, passages, prefix_trie, quality_classifier, quality_rules, sentence_pieces, warc

_MODULES = (chat, warc, exact_dedup, mixing, quality_rules, language_id, near_dedup, sentence_pieces, passages, quality_classifier, prefix_trie, alignment, packing)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
