"""The driver queries of the knowledge-store operators and their DuckDB SQL."""

from __future__ import annotations

from . import queries as q
from . import sql

QUERIES = {f.__name__: f for f in q.ALL}
ORACLE_SQL = {name: text for name, text in sql.SQL.items() if name in QUERIES}
