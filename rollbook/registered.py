"""Registered queries over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from .plans import entities, extraction, filters, flows, joins, layers, ordering, records, scalars, stats, streams

MODULES = (scalars, joins, entities, layers, records, filters, extraction, stats, ordering, flows, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
