"""All queries over the driver's tables, by name, and their SQL."""

from factloom.queries import ORACLE_SQL, QUERIES, extraction, forest, planning, statements

__all__ = ["ORACLE_SQL", "QUERIES", "extraction", "forest", "planning", "statements"]
