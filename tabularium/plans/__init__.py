"""Prepared queries over a star schema of sales, each with the SQL it is held against."""

from __future__ import annotations

from tabularium.plans import cleaning, comparison, filters, related, relations, repair, reporting, requests, sales, services
from tabularium.streaming import events

MODULES = (sales, relations, related, cleaning, requests, comparison, services, reporting, repair, filters, events)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
