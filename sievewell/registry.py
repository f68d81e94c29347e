"""All registered queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

from .queries import governance, graphs, retrieval, routing, star, surface, text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (text, retrieval, surface, routing, graphs, governance, star):
    QUERIES |= _m.R.queries
    ORACLE_SQL |= _m.R.sql
