"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from routeloom.plans import extra, policy_sql, queries, sql

QUERIES = queries.QUERIES | extra.QUERIES
ORACLE_SQL = sql.ORACLE_SQL | policy_sql.ORACLE_SQL | extra.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES"]
