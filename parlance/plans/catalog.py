"""Registered queries of the core and their oracle SQL."""

from __future__ import annotations

from parlance.plans import files, files_sql, hierarchy_queries, workspace, workspace_sql

QUERIES = workspace.QUERIES | files.QUERIES | hierarchy_queries.QUERIES
ORACLE = workspace_sql.ORACLE | files_sql.ORACLE | hierarchy_queries.ORACLE
