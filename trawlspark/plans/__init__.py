"""The catalogue of queries over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from . import builds, corpora, searches, segmenting, states

MODULES = (searches, corpora, segmenting, states, builds)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
