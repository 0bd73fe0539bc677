"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from lodesift.plans import problems, problems_sql, scanner, scanner_sql

QUERIES = {**problems.QUERIES, **scanner.QUERIES}
ORACLE = {**problems_sql.ORACLE, **scanner_sql.ORACLE}
