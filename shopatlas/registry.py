"""Registered queries of the location operators, with their SQL."""
from __future__ import annotations

from .queries import functions, maintenance, pipeline, records, search, sources

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (search, functions, sources, maintenance, pipeline, records):
    QUERIES |= _module.BOOK.queries
    ORACLE_SQL |= _module.BOOK.sql
