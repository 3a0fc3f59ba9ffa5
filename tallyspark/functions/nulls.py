"""Missing values.

pandas has one missing marker (NaN) that ``first``, ``cumsum`` and ``max`` skip.
Spark has NULL *and* NaN, and NaN poisons ``sum``.  Every numeric input column
is normalised NaN -> NULL on entry so that the aggregate and window semantics
line up with the pandas ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)
