"""The corpus operators' queries and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from tabularium.llm import alignment, chat, language, lexical, licenses, media, mixing, neighbours, packing, quality, simhash, toxicity, urls

MODULES = (mixing, licenses, neighbours, media, toxicity, packing, chat, simhash, quality, language, lexical, alignment, urls)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
