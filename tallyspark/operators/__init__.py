"""Operators: pure ``DataFrame -> DataFrame`` functions on Spark built-ins."""
