"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, licences, line_dedup, mixing, nearest, neardup, prefix_trie, quality, sharding, toxicity, url_lists, whitening

MODULES = (sharding, quality, licences, neardup, decontaminate, toxicity, html_text, url_lists, line_dedup, mixing, whitening, nearest, prefix_trie)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
