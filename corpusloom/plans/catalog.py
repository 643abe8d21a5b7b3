"""Registry of the engine's queries and their DuckDB oracles."""

from __future__ import annotations

from . import conversations, decoders, documents, evaluation, recipes, tasks

MODULES = (documents, conversations, recipes, evaluation, tasks, decoders)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "doc_source_report"
