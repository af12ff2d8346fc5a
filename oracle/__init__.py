"""Independent DuckDB statements for every SQL-checkable query."""

from oracle.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
