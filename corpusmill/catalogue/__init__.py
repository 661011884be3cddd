"""All queries of the library outside corpusmill.llm, with their DuckDB equivalents."""

from __future__ import annotations

from corpusmill.catalogue import analysis, code, datasets, editing, extraction, generic, quality, transform

_MODULES = (quality, transform, datasets, analysis, code, extraction, editing, generic)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
