"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from . import findings_queries, study_queries

PARTS = [findings_queries, study_queries]
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
