"""Named query plans over the test tables and their DuckDB oracle SQL."""

from tallyspark.plans.registry import QUERIES
from tallyspark.plans.oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]
