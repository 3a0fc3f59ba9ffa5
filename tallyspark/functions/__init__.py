"""Scalar column helpers (no Python UDFs: everything here is a Column expression)."""

from tallyspark.functions.nulls import nan_to_null
from tallyspark.functions.rates import periodic_rate, discount, pct_change
from tallyspark.functions.text import money_text, pct_text, two_dec_text

__all__ = ["nan_to_null", "periodic_rate", "discount", "pct_change",
           "money_text", "pct_text", "two_dec_text"]
